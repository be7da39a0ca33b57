"""Notes: headers, bodies, attachments and MIME text. Contacts: vCard text. Posts: their body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import binary, rtf, text

HEADER = "array<struct<name:string,value:string>>"
PREAMBLE = "This is a multi-part message in MIME format.\r\n"


def date_of(*times: Column) -> Column:
    """The first time there is: delivery, submission, modification, creation."""
    return F.coalesce(*times)


def unless(value: Column, usual: str) -> Column:
    """A header's value, null if it is the usual one."""
    return F.nullif(value.cast("string"), F.lit(usual))


def generated_headers(items: DataFrame) -> Column:
    """Headers made from properties, in order; those without a value are left out. items: one row a note, with the columns
    used here and transport (parsed transport headers)."""
    has = lambda name: F.exists("transport", lambda h: h["name"] == name)
    sender = text.sender_address(F.col("sender_addrtype"), F.col("sender_name"), F.col("sender_email_address"), text.header_joined(F.col("transport"), "From"))
    # headers that never replace a transport header, and those that do
    mapped = [
        ("Message-ID", F.col("internet_message_id")), ("In-Reply-To", F.col("in_reply_to_id")), ("Importance", unless(F.col("importance"), "1")),
        ("Priority", unless(F.col("priority"), "1")), ("Sensitivity", unless(F.col("sensitivity"), "0")), ("Thread-Topic", F.col("conversation_topic")),
        ("Disposition-Notification-To", F.when(F.col("read_receipt_requested"), sender)),
    ]
    own = [("From", sender), ("To", F.col("To")), ("Cc", F.col("Cc")), ("Bcc", F.col("Bcc")), ("Subject", F.col("subject"))]
    own.append(("Date", F.when(~has("Date"), text.rfc2822(F.col("date")))))
    own += [(n, v) for n, v in mapped]
    made = F.array(*[F.struct(F.lit(n).alias("name"), v.cast("string").alias("value")) for n, v in own])
    return F.filter(made, lambda h: h["value"].isNotNull())


def merged_headers(made: Column, transport: Column, content: Column) -> Column:
    """The message's headers: transport headers in their order, each replaced by the generated one of its name; generated
    ones without a transport header; then the content's own, which win over both, Content-Type last. Transport headers
    that speak of base64 content are dropped."""
    lower = lambda a: F.transform(a, lambda h: F.lower(h["name"]))
    kept = F.filter(transport, lambda h: ~F.array_contains(lower(made), F.lower(h["name"])) & ~F.array_contains(lower(content), F.lower(h["name"])) & ~(F.lower(h["name"]).contains("content-type") & h["value"].contains("base64")))
    own = F.filter(made, lambda h: ~F.array_contains(lower(content), F.lower(h["name"])))
    last = F.lower(F.lit("Content-Type"))
    return F.concat(own, kept, F.filter(content, lambda h: F.lower(h["name"]) != last), F.filter(content, lambda h: F.lower(h["name"]) == last))


def with_bodies(items: DataFrame) -> DataFrame:
    """items with text_body (body, else the RTF's text), rtf_body and html_body (html, else what the RTF carries or makes)."""
    out = items.withColumn("rtf_body", rtf.rtf_column(F.col("rtf_compressed")))
    plain = F.coalesce(text.blank_to_null(F.col("body")), F.when(F.col("rtf_body").isNotNull(), rtf.text_column(F.col("rtf_body"))), F.col("body"))
    html = F.coalesce(text.blank_to_null(F.col("body_html")), F.when(F.col("rtf_body").isNotNull(), rtf.html_column(F.col("rtf_body"))))
    return out.withColumn("text_body", plain).withColumn("html_body", html)


def part(content_type: str | Column, body: Column, *more: Column) -> Column:
    """A part as text: headers, an empty line, the body. more: (name, value) structs or null."""
    kind = F.lit(content_type) if isinstance(content_type, str) else content_type
    lines = F.concat(F.lit("Content-Type: "), kind, F.lit("\r\n"))
    for extra in more:
        lines = F.concat(lines, F.coalesce(extra, F.lit("")))
    return F.concat(lines, F.lit("\r\n"), body)


def header_line(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")))


def joined_parts(preamble: Column, parts: Column, mark: Column) -> Column:
    """A multipart body: the preamble, each part after its boundary, and the closing boundary."""
    inner = F.concat(F.array(preamble), F.transform(parts, lambda p: F.concat(F.lit("\r\n"), p, F.lit("\r\n"))), F.array(F.lit("--\r\n")))
    return F.array_join(inner, F.concat(F.lit("\r\n--"), mark), None) if isinstance(mark, str) else F.aggregate(F.slice(inner, 2, F.size(inner) - 1), F.element_at(inner, 1), lambda a, p: F.concat(a, F.lit("\r\n--"), mark, p))


def multipart_type(kind: Column, mark: Column) -> Column:
    return F.concat(kind, F.lit('; boundary="'), mark, F.lit('"'))


def attachment_name(long: Column, short: Column) -> Column:
    return F.coalesce(long, short)


def attachment_parts(attachments: DataFrame) -> DataFrame:
    """attachments with part: base64 text, or the embedded message as it is (embedded_mime, embedded_subject)."""
    name = attachment_name(F.col("attach_long_filename"), F.col("attach_filename"))
    quoted = lambda n: F.concat(F.lit('attachment; filename="'), F.coalesce(n, F.lit("")), F.lit('"'))
    plain = part(
        F.coalesce("attach_mime_tag", F.lit("application/octet-stream")), F.coalesce(binary.base64_lines(F.col("attach_data")), F.lit("")),
        header_line("Content-Disposition", quoted(name)), header_line("Content-Transfer-Encoding", F.lit("base64")),
        header_line("Content-Location", F.col("attach_content_location")), header_line("Content-ID", F.col("attach_content_id")),
    )
    nested = part("message/rfc822", F.col("embedded_mime"), header_line("Content-Disposition", quoted(F.col("embedded_subject"))), header_line("Content-Location", F.col("attach_content_location")), header_line("Content-ID", F.col("attach_content_id")))
    return attachments.withColumns({"filename": name, "part": F.when(F.col("embedded_mime").isNotNull(), nested).otherwise(plain), "related": F.col("attach_content_location").isNotNull() | F.col("attach_content_id").isNotNull()})


def overlay(rows: DataFrame, own: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Properties of table rows with those of the rows' own lists over them: equal keys replaced, others added."""
    right = own.select(*keys, F.col(value).alias("_own"), F.lit(True).alias("_has"))
    out = rows.select(*keys, value).join(right, keys, "full_outer")
    return out.select(*keys, F.when(F.col("_has"), F.col("_own")).otherwise(F.col(value)).alias(value))


def to_mime(items: DataFrame, attachments: DataFrame | None = None) -> DataFrame:
    """(item_id, mime): the whole message as text. items: notes with the columns of generated_headers, text_body, rtf_body,
    html_body and transport. attachments: as attachment_parts gives them, with item_id and ord; a message's attachments are
    held in memory together, as they are in its text."""
    if attachments is None:
        items = items.withColumns({"parts": F.array().cast("array<string>"), "related": F.lit(False)})
    else:
        listed = attachments.groupBy("item_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "part"))), lambda x: x["part"]).alias("parts"), F.bool_or("related").alias("related"))
        items = items.join(listed, "item_id", "left").withColumns({"parts": F.coalesce("parts", F.array().cast("array<string>")), "related": F.coalesce("related", F.lit(False))})
    outer, inner = text.boundary(F.col("item_id"), F.lit(1)), text.boundary(F.col("item_id"), F.lit(2))
    with_parts, several = F.size("parts") > 0, F.col("rtf_body").isNotNull() | F.col("html_body").isNotNull()
    mark = F.when(with_parts, inner).otherwise(outer)
    choices = F.filter(F.array(F.when(F.col("text_body").isNotNull(), part("text/plain", F.col("text_body"))), F.when(F.col("html_body").isNotNull(), part("text/html", F.col("html_body")))), lambda x: x.isNotNull())
    body_type = F.when(several, multipart_type(F.lit("multipart/alternative"), mark)).otherwise("text/plain")
    preamble = F.when(with_parts, F.lit("")).otherwise(PREAMBLE)
    body = F.when(several, joined_parts(preamble, choices, mark)).otherwise(F.coalesce("text_body", F.lit("")))
    kind = F.when(with_parts, multipart_type(F.when(F.col("related"), "multipart/related").otherwise("multipart/mixed"), outer)).otherwise(body_type)
    whole = F.when(with_parts, joined_parts(F.lit(PREAMBLE), F.concat(F.array(part(body_type, body)), F.col("parts")), outer)).otherwise(body)
    content = F.array(F.struct(F.lit("Content-Type").alias("name"), kind.alias("value")))
    merged = merged_headers(generated_headers(items), F.col("transport"), content)
    lines = F.array_join(F.transform(merged, lambda h: F.concat(h["name"], F.lit(": "), h["value"], F.lit("\r\n"))), "")
    return items.select("item_id", F.concat(lines, F.lit("\r\n"), whole).alias("mime"))


def summary(items: DataFrame) -> DataFrame:
    """items with summary: class, sender and subject of each on one line. items: message_class, sender, subject."""
    shown = lambda c: F.coalesce(F.concat(F.lit('"'), F.col(c), F.lit('"')), F.lit("nil"))
    return items.withColumn("summary", F.format_string("#<Message message_class=%s from=%s subject=%s>", shown("message_class"), shown("sender"), shown("subject")))


def counts(items: DataFrame, recipients: DataFrame, attachments: DataFrame) -> DataFrame:
    """(item_id, n_recipients, n_attachments) of all items."""
    one = lambda rows, name: rows.groupBy("item_id").agg(F.count(F.lit(1)).alias(name))
    out = items.select("item_id").join(one(recipients, "n_recipients"), "item_id", "left").join(one(attachments, "n_attachments"), "item_id", "left")
    return out.na.fill(0, ["n_recipients", "n_attachments"])


def vcard(fields: dict[str, Column]) -> Column:
    """vCard 3.0 text from contact fields by symbol; empty values count as missing, groups without a value are left out."""
    get = lambda name: text.empty_to_null(fields[name]) if name in fields else F.lit(None).cast("string")
    line = lambda head, value: F.when(value.isNotNull(), F.concat(F.lit(head), text.vcard_escape(value)))
    family, given, full = get("surname"), get("given_name"), get("subject")
    name = F.concat(F.lit("N:"), text.vcard_escape(F.coalesce(family, F.lit(""))), F.lit(";"), text.vcard_escape(F.coalesce(given, F.lit(""))), F.lit(";;;"))
    has_name = family.isNotNull() | given.isNotNull() | full.isNotNull()
    # city and state are joined as they are: a blank one stays
    city, state = (fields.get(n, F.lit(None).cast("string")) for n in ("business_address_city", "business_address_state"))
    place = text.empty_to_null(F.concat_ws(", ", city, state))
    street = get("business_address_street")
    work = F.concat(F.lit("ADR;TYPE=work:;;"), text.vcard_escape(F.coalesce(street, F.lit(""))), F.lit(";"), text.vcard_escape(F.coalesce(place, F.lit(""))), F.lit(";;;"))
    email = F.coalesce(get("email_email_address"), get("email_original_display_name"))
    smtp = F.coalesce(fields.get("email_addr_type", F.lit(None).cast("string")), F.lit("")) == "SMTP"
    lines = [
        F.lit("BEGIN:VCARD"), F.lit("VERSION:3.0"), F.when(has_name, name), line("FN:", full), F.when(place.isNotNull() | street.isNotNull(), work),
        line("BDAY:", get("birthday")), line("NICKNAME:", get("nickname")), line("URL:", get("business_home_page")),
        line("X-EVOLUTION-FILE-AS:", get("file_under")), F.when(email.isNotNull(), F.concat(F.when(smtp, "EMAIL:").otherwise("EMAIL;TYPE=x400:"), email)),
        line("ORG:", get("company_name")), F.lit("END:VCARD"),
    ]
    folded = F.transform(F.filter(F.array(*lines), lambda x: x.isNotNull()), lambda x: text.fold(x))
    return F.concat(F.array_join(folded, "\n"), F.lit("\n"))
