"""A message store derived from the star-schema tables, as SQL that Spark and DuckDB both run.

region and nation are folders, customers are contacts in their nation's folder, documents are notes, conversations are posts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..dictionary import PS_MAPI, PS_PUBLIC_STRINGS, PSETID_ADDRESS, GUIDS

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _property(ord_: int, code: int | None, guid: str, value: str, where: str = "", name: str | None = None) -> str:
    key = f"CAST({code if code is not None else 'NULL'} AS INT) AS code, CAST({repr(name) if name else 'NULL'} AS STRING) AS name"
    return f"SELECT c_custkey AS item_id, {ord_} AS ord, {key}, '{guid}' AS guid, {value} AS value FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey {where}"


#: item_id, ord, code, name, guid, value: the contacts' properties, with repeated keys and clashing symbols.
PROPERTIES = " UNION ALL ".join([
    _property(0, 0x001A, PS_MAPI, "'IPM.Contact'"), _property(1, 0x0037, PS_MAPI, "c_name"), _property(2, 0x3A06, PS_MAPI, "c_mktsegment"),
    _property(3, 0x3A11, PS_MAPI, "n_name"), _property(4, 0x3A16, PS_MAPI, "concat('Trade; ', r_name, ', Ltd')"), _property(5, 0x8005, PSETID_ADDRESS, "c_name"),
    _property(6, 0x8046, PSETID_ADDRESS, "n_name"), _property(7, 0x8047, PSETID_ADDRESS, "r_name"),
    _property(8, 0x8082, PSETID_ADDRESS, "CASE WHEN c_custkey % 3 = 0 THEN 'SMTP' ELSE 'EX' END"), _property(9, 0x8083, PSETID_ADDRESS, "concat(lower(c_name), '@example.com')"),
    _property(10, None, PS_PUBLIC_STRINGS, "c_mktsegment", name="Keywords"), _property(11, 0x8888, PS_MAPI, "'unmapped'"),
    _property(12, 0x0037, PS_MAPI, "concat(c_name, ' again')", "WHERE c_custkey % 5 = 0"), _property(13, 0x8104, GUIDS["PSETID_Task"], "'task'"),
    _property(14, 0x820D, GUIDS["PSETID_Appointment"], "'appointment'", "WHERE c_custkey % 2 = 0"), _property(15, 0x0037, GUIDS["PSETID_Log"], "'elsewhere'", "WHERE c_custkey % 7 = 0"),
])

#: node_id, parent_id, ord, display_name, kind: the root (its own parent), regions, nations, customers; one orphan a nation 24.
NODES = """
SELECT CAST(33 AS BIGINT) AS node_id, CAST(33 AS BIGINT) AS parent_id, 0 AS ord, 'Root' AS display_name, 'root' AS kind
UNION ALL SELECT CAST(100 + r_regionkey AS BIGINT), CAST(33 AS BIGINT), r_regionkey, r_name, 'region' FROM region
UNION ALL SELECT CAST(1000 + n_nationkey AS BIGINT), CAST(CASE WHEN n_nationkey = 24 THEN 999 ELSE 100 + n_regionkey END AS BIGINT), n_nationkey, n_name, 'nation' FROM nation"""
CUSTOMER_NODES = "SELECT 100000 + c_custkey AS node_id, CAST(1000 + c_nationkey AS BIGINT) AS parent_id, CAST(c_custkey % 10 AS INT) AS ord, c_name AS display_name FROM customer"

#: item_id, ord, recipient columns: two to four recipients of each order.
RECIPIENTS = """
SELECT l_orderkey AS item_id, l_linenumber AS ord, CAST(l_linenumber % 4 AS INT) AS recipient_type,
  CASE WHEN l_linenumber % 2 = 0 THEN concat('''', s_name, '''') END AS transmittable_display_name, s_name AS display_name,
  CASE WHEN l_linenumber % 3 = 0 THEN concat(lower(s_name), '@example.com') END AS smtp_address,
  CASE WHEN l_linenumber % 5 = 0 THEN 'org@example.com' END AS org_email_addr, CASE WHEN l_linenumber % 4 <> 3 THEN s_name END AS email_address
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"""

#: item_id and the columns that note headers come from, one row an order.
NOTES = """
SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 4 <> 0 THEN concat('Doe, ', c_mktsegment) END AS sender_name,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN concat('u', o_custkey, '@example.com') ELSE concat('/O=ACME/OU=X/CN=U', o_custkey) END AS sender_email_address,
  CASE WHEN o_orderkey % 3 = 0 THEN 'SMTP' ELSE 'EX' END AS sender_addrtype, concat('Order ', o_orderkey) AS subject,
  CAST(o_orderkey % 3 AS INT) AS importance, CAST(o_orderkey % 2 AS INT) AS priority, CAST(o_orderkey % 2 AS INT) AS sensitivity,
  CASE WHEN o_orderkey % 6 = 0 THEN concat('<', o_orderkey, '@example.com>') END AS internet_message_id, CAST(NULL AS STRING) AS in_reply_to_id,
  o_orderpriority AS conversation_topic, o_orderkey % 10 = 0 AS read_receipt_requested,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END AS message_delivery_time, o_orderdate AS creation_time,
  CASE WHEN o_orderkey % 7 = 0 THEN concat('From: t', o_custkey, '@example.com', chr(10), 'X-Seen: a', chr(10), chr(9), 'b  c', chr(10), 'subject: old', chr(10), 'X-Seen: two', chr(10), chr(10), 'body') ELSE '' END AS transport_headers
FROM orders JOIN customer ON o_custkey = c_custkey"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of one of the queries above; tables are read from sf_dir."""
    named = {t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", sql)}
    for t in named:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **named)
