"""Property names: namespaces, tags and named properties.

The full tag dictionary is a parameter: read_tags(path) takes a file of `code: [NAME, TYPE]` entries. Built in are the codes
that the operators themselves use.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: The first group of well-known namespace GUIDs and their names.
NAMESPACES = {
    "00020328": "PS_MAPI", "00020329": "PS_PUBLIC_STRINGS", "00020380": "PS_ROUTING_EMAIL_ADDRESSES", "00020381": "PS_ROUTING_ADDRTYPE",
    "00020382": "PS_ROUTING_DISPLAY_NAME", "00020383": "PS_ROUTING_ENTRYID", "00020384": "PS_ROUTING_SEARCH_KEY", "00020386": "PS_INTERNET_HEADERS",
    "00062002": "PSETID_Appointment", "00062003": "PSETID_Task", "00062004": "PSETID_Address", "00062008": "PSETID_Common",
    "0006200a": "PSETID_Log", "0006200e": "PSETID_Note",
}
GUID_TAIL = "-0000-0000-c000-000000000046"
GUIDS = {name: head + GUID_TAIL for head, name in NAMESPACES.items()}
NAMES = {guid: name for name, guid in GUIDS.items()}
PS_MAPI, PS_PUBLIC_STRINGS, PSETID_ADDRESS = GUIDS["PS_MAPI"], GUIDS["PS_PUBLIC_STRINGS"], GUIDS["PSETID_Address"]

#: Property types by code.
TYPES = {
    0x0001: "PT_NULL", 0x0002: "PT_SHORT", 0x0003: "PT_LONG", 0x0004: "PT_FLOAT", 0x0005: "PT_DOUBLE", 0x0006: "PT_CURRENCY", 0x0007: "PT_APPTIME",
    0x000A: "PT_ERROR", 0x000B: "PT_BOOLEAN", 0x000D: "PT_OBJECT", 0x0014: "PT_I8", 0x001E: "PT_STRING8", 0x001F: "PT_UNICODE", 0x0040: "PT_SYSTIME",
    0x0048: "PT_CLSID", 0x0102: "PT_BINARY", 0x1003: "PT_MV_LONG", 0x1014: "PT_MV_I8", 0x101E: "PT_MV_STRING8", 0x101F: "PT_MV_UNICODE", 0x1102: "PT_MV_BINARY",
}

#: Tags of namespace PS_MAPI that the operators use.
TAGS = {
    0x0017: "importance", 0x001A: "message_class", 0x0026: "priority", 0x0029: "read_receipt_requested", 0x0036: "sensitivity", 0x0037: "subject",
    0x0039: "client_submit_time", 0x0070: "conversation_topic", 0x007D: "transport_message_headers", 0x0C15: "recipient_type", 0x0C1A: "sender_name",
    0x0C1E: "sender_addrtype", 0x0C1F: "sender_email_address", 0x0E04: "display_to", 0x0E06: "message_delivery_time", 0x1000: "body",
    0x1009: "rtf_compressed", 0x1013: "body_html", 0x1035: "internet_message_id", 0x1042: "in_reply_to_id", 0x3001: "display_name",
    0x3002: "addrtype", 0x3003: "email_address", 0x3007: "creation_time", 0x3008: "last_modification_time", 0x35DF: "valid_folder_mask",
    0x35E0: "ipm_subtree_entryid", 0x35E3: "ipm_wastebasket_entryid", 0x35E7: "finder_entryid", 0x3602: "content_count", 0x360A: "subfolders",
    0x3701: "attach_data", 0x3704: "attach_filename", 0x3705: "attach_method", 0x3707: "attach_long_filename", 0x370E: "attach_mime_tag",
    0x3712: "attach_content_id", 0x3713: "attach_content_location", 0x39FE: "smtp_address", 0x3A06: "given_name", 0x3A08: "business_telephone_number",
    0x3A11: "surname", 0x3A15: "postal_address", 0x3A16: "company_name", 0x3A17: "title", 0x3A18: "department_name", 0x3A19: "office_location",
    0x3A20: "transmittable_display_name", 0x3A42: "birthday", 0x3A4F: "nickname", 0x3A51: "business_home_page", 0x403E: "org_email_addr",
}

#: Named properties by namespace and code.
NAMED = {
    "PSETID_Address": {
        0x8005: "file_under", 0x8017: "last_name_and_first_name", 0x8018: "company_and_full_name", 0x8019: "full_name_and_company",
        0x801A: "home_address", 0x801B: "business_address", 0x801C: "other_address", 0x8022: "selected_address", 0x802B: "web_page",
        0x802C: "yomi_first_name", 0x802D: "yomi_last_name", 0x802E: "yomi_company_name", 0x8030: "last_first_no_space",
        0x8031: "last_first_space_only", 0x8032: "company_last_first_no_space", 0x8033: "company_last_first_space_only",
        0x8034: "last_first_no_space_company", 0x8035: "last_first_space_only_company", 0x8036: "last_first_and_suffix",
        0x8045: "business_address_street", 0x8046: "business_address_city", 0x8047: "business_address_state", 0x8048: "business_address_postal_code",
        0x8049: "business_address_country", 0x804A: "business_address_post_office_box", 0x804F: "user_field1", 0x8050: "user_field2",
        0x8051: "user_field3", 0x8052: "user_field4", 0x8062: "imaddress", 0x8082: "email_addr_type", 0x8083: "email_email_address",
        0x8084: "email_original_display_name", 0x8085: "email_original_entry_id", 0x8092: "email2_addr_type", 0x8093: "email2_email_address",
        0x8094: "email2_original_display_name", 0x8095: "email2_original_entry_id", 0x80A2: "email3_addr_type", 0x80A3: "email3_email_address",
        0x80A4: "email3_original_display_name", 0x80A5: "email3_original_entry_id", 0x80D8: "internet_free_busy_address",
    },
    "PSETID_Task": {
        0x8101: "status", 0x8102: "percent_complete", 0x8103: "team_task", 0x8104: "start_date", 0x8105: "due_date", 0x8106: "duration",
        0x810F: "date_completed", 0x8110: "actual_work", 0x8111: "total_work", 0x811C: "complete", 0x811F: "owner", 0x8126: "is_recurring",
    },
    "PSETID_Appointment": {
        0x8205: "busy_status", 0x8208: "location", 0x820D: "start_date", 0x820E: "end_date", 0x8213: "duration", 0x8214: "colors",
        0x8216: "recurrence_state", 0x8218: "response_status", 0x8222: "reply_time", 0x8223: "is_recurring", 0x822E: "organizer",
        0x8231: "recurrence_type", 0x8232: "recurrence_pattern",
    },
    "PSETID_Common": {
        0x8502: "reminder_time", 0x8503: "reminder_set", 0x8516: "common_start", 0x8517: "common_end", 0x851C: "reminder_override",
        0x851E: "reminder_sound", 0x851F: "reminder_file", 0x8530: "flag_text", 0x8534: "mileage", 0x8535: "billing_information",
        0x8539: "companies", 0x853A: "contact_names", 0x8560: "reminder_next_time",
    },
    "PSETID_Log": {
        0x8700: "entry", 0x8704: "start_date", 0x8705: "start_time", 0x8706: "start", 0x8707: "duration", 0x8708: "end", 0x870E: "doc_printed",
        0x870F: "doc_saved", 0x8710: "doc_routed", 0x8711: "doc_posted", 0x8712: "entry_type",
    },
    "PSETID_Note": {0x8B00: "color", 0x8B02: "width", 0x8B03: "height"},
}

_ENTRY = re.compile(r"^\"?([0-9a-fA-F]{4})\"?:\s*\n- (\S+)\s*\n- (\S+)", re.M)


def read_tags(spark: SparkSession, path: str) -> dict[int, str]:
    """Names of a tag dictionary file by code: what stands behind the first underscore, in lower case."""
    text = "\n".join(r[0] for r in spark.read.text(path).collect())  # a dictionary file of some thousand lines
    return {int(code, 16): name.split("_", 1)[1].lower() for code, name, _ in _ENTRY.findall(text)}


def dictionary(spark: SparkSession, tags: dict[int, str] | None = None) -> DataFrame:
    """(code, guid, symbol) of all numeric keys; one row a key, some hundreds to thousands."""
    rows = [(c, PS_MAPI, n) for c, n in (tags or TAGS).items()]
    rows += [(c, GUIDS[space], n) for space, own in NAMED.items() for c, n in own.items()]
    return spark.createDataFrame(rows, "code int, guid string, symbol string")


def namespaces(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NAMES.items()), "guid string, namespace string")
