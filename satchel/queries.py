"""Registered queries of the message-store operators, each with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dictionary as names
from .functions import binary, text
from .operators import messages, mime, people, properties, store, tree
from .operators.checks import Notes, checked
from .operators.scratch import fresh_path, written
from .plans import synth
from .plans.synth import derive, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


_USED = {(c, names.PS_MAPI): n for c, n in names.TAGS.items()} | {(c, names.GUIDS[s]): n for s, own in names.NAMED.items() for c, n in own.items()}
_PROPS = f"WITH props AS ({synth.PROPERTIES})"
_DICT = "dict AS (SELECT * FROM (VALUES " + ", ".join(f"({c}, '{g}', '{n}')" for (c, g), n in _USED.items()) + ") t(code, guid, symbol))"
_NAMED = f"{_PROPS}, {_DICT}, named AS (SELECT p.*, coalesce(lower(p.name), d.symbol) AS symbol FROM props p LEFT JOIN dict d ON p.code = d.code AND p.guid = d.guid)"
_ONE = f"{_NAMED}, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, symbol ORDER BY CASE WHEN guid = '{names.PS_MAPI}' THEN 0 ELSE 1 END, CASE WHEN guid = '{names.PS_MAPI}' THEN -ord ELSE ord END) AS k FROM named WHERE symbol IS NOT NULL) WHERE k = 1)"


def _or(number: int, column: str):
    """A number column with a number for null, under its own name."""
    return F.coalesce(F.col(column), F.lit(number)).alias(column.rpartition(".")[2])


def _props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, synth.PROPERTIES)


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return properties.with_symbol(_props(spark, sf_dir), names.dictionary(spark))


def _one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return properties.one_for_each_symbol(_named(spark, sf_dir))


@register(f"{_NAMED} SELECT symbol, count(*) AS n FROM named GROUP BY symbol")
def prop_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


_SPACES = "(VALUES " + ", ".join(f"('{g}', '{n}')" for g, n in names.NAMES.items()) + ") s(guid, space)"


@register(f"""{_PROPS} SELECT CASE WHEN p.name IS NOT NULL THEN '#<Key ' || s.space || '/"' || p.name || '">' WHEN p.guid = '{names.PS_MAPI}' THEN printf('0x%04x', p.code)
 ELSE '#<Key ' || s.space || '/' || printf('0x%04x', p.code) || '>' END AS key, count(*) AS n FROM props p LEFT JOIN {_SPACES} ON p.guid = s.guid GROUP BY 1""")
def prop_key_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return properties.key_text(names.namespaces(spark))(_props(spark, sf_dir)).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def _pick(order: str) -> str:
    return f"{_PROPS} SELECT item_id, coalesce(code, -1) AS code, name, guid, value FROM (SELECT *, row_number() OVER (PARTITION BY item_id, code, name, guid ORDER BY ord {order}) AS k FROM props) WHERE k = 1"


@register(_pick("DESC"))
def prop_dedup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return properties.last_wins(_props(spark, sf_dir)).select("item_id", _or(-1, "code"), "name", "guid", "value")


@register(_pick("ASC"))
def prop_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return properties.first_wins(_props(spark, sf_dir)).select("item_id", _or(-1, "code"), "name", "guid", "value")


@register(f"{_ONE} SELECT item_id, symbol, guid, value FROM one")
def prop_symbol_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, sf_dir).select("item_id", "symbol", "guid", "value")


_RECORD = ["message_class", "subject", "surname", "given_name", "company_name", "file_under", "business_address_city", "business_address_state", "email_addr_type", "email_email_address", "keywords"]


@register(f"{_ONE} SELECT item_id, " + ", ".join(f"max(CASE WHEN symbol = '{s}' THEN value END) AS {s}" for s in _RECORD) + " FROM one GROUP BY item_id")
def prop_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return properties.to_records(_one(spark, sf_dir), _RECORD)


@register(f"{_PROPS} SELECT item_id, value FROM props WHERE code = 55 AND guid = '{names.PS_MAPI}'")
def prop_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return properties.lookup(_props(spark, sf_dir), code=0x37).select("item_id", "value")


@register(f"{_ONE} SELECT item_id, string_agg(symbol, ',' ORDER BY symbol) AS symbols, count(*) AS n FROM one GROUP BY item_id")
def prop_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return properties.symbols(_one(spark, sf_dir)).select("item_id", F.array_join("symbols", ",").alias("symbols"), F.size("symbols").cast("long").alias("n"))


@register(f"""{_ONE} SELECT item_id, string_agg(symbol || '=' || CASE WHEN length('"' || value || '"') > 32 THEN substring('"' || value || '"', 1, 30) || '..."' ELSE '"' || value || '"' END, ' ' ORDER BY symbol) AS text FROM one GROUP BY item_id""")
def prop_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return properties.shown(_one(spark, sf_dir))


@register(f"{_PROPS} SELECT item_id, code, guid, count(*) AS copies FROM props GROUP BY item_id, code, guid HAVING count(*) > 1")
def prop_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return properties.duplicates(_props(spark, sf_dir), ["item_id", "code", "guid"])


@register(f"""{_PROPS}, m AS (SELECT * FROM (VALUES (32773, 33029, NULL, 'g1'), (34952, NULL, 'Custom', 'g2')) t(pseudo, code, name, guid))
 SELECT p.item_id, p.ord, coalesce(CASE WHEN m.pseudo IS NULL THEN p.code ELSE m.code END, -1) AS code, m.name, CASE WHEN m.pseudo IS NULL THEN '{names.PS_MAPI}' ELSE m.guid END AS guid, p.value FROM props p LEFT JOIN m ON p.code >= 32768 AND p.code = m.pseudo""")
def named_key_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([(32773, 33029, None, "g1"), (34952, None, "Custom", "g2")], "pseudo int, code int, name string, guid string")
    return properties.named_keys(_props(spark, sf_dir), known).select("item_id", "ord", _or(-1, "code"), "name", "guid", "value")


@register("SELECT l_orderkey AS item_id, string_agg(coalesce(v, '-'), ',' ORDER BY i) AS joined FROM (SELECT k.l_orderkey, i, l.l_returnflag AS v FROM (SELECT l_orderkey, unnest(range(0, max(l_linenumber) + 1)) AS i FROM lineitem GROUP BY l_orderkey) k LEFT JOIN (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2) l ON k.l_orderkey = l.l_orderkey AND k.i = l.l_linenumber) GROUP BY l_orderkey")
def multi_value_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("place")).agg(F.max("l_returnflag").alias("value"))
    out = properties.assemble(pieces, ["item_id"])
    return out.select("item_id", F.array_join("values", ",", "-").alias("joined"))


_STREAMS = "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN '__substg1.0_0037001F' WHEN 1 THEN concat('__substg1.0_8005101E-0000000', p_partkey % 9) WHEN 2 THEN '__substg1.0_8005101E' WHEN 3 THEN '__properties_version1.0' ELSE concat('odd', p_size % 3) END AS name FROM part"


@register(f"SELECT id, CASE id % 5 WHEN 0 THEN 55 ELSE 32773 END AS code, CASE id % 5 WHEN 0 THEN 31 WHEN 1 THEN 30 ELSE 4126 END AS type, CASE WHEN id % 5 = 1 THEN CAST(id % 9 AS INT) ELSE -1 END AS place, id % 5 <> 0 AS multi, id % 5 = 2 AS header FROM ({_STREAMS}) WHERE id % 5 < 3")
def substream_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = derive(spark, sf_dir, _STREAMS).withColumn("s", properties.substream(F.col("name"))).where("s is not null")
    return out.select("id", "s.code", "s.type", _or(-1, "s.place"), "s.multi", "s.header")


@register(f"SELECT name, count(*) AS count FROM ({_STREAMS}) WHERE id % 5 = 4 GROUP BY name")
def unknown_stream_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return properties.unknown_streams(derive(spark, sf_dir, _STREAMS))


_CLASSES = "SELECT doc_id AS id, CASE WHEN doc_id % 9 = 0 THEN 'ipm.note' WHEN doc_id % 7 = 0 THEN 'IPM.StickyNote' ELSE 'IPM.Note' END AS message_class FROM documents UNION ALL SELECT conv_id, 'IPM.Post' FROM conversations UNION ALL SELECT c_custkey, 'IPM.Contact' FROM customer UNION ALL SELECT s_suppkey, 'REPORT.IPM.Note' FROM supplier"


@register(f"SELECT mime, CASE mime WHEN 'text/x-vcard' THEN 'vcf' WHEN 'message/rfc822' THEN 'eml' ELSE 'txt' END AS ext, count(*) AS n FROM (SELECT CASE message_class WHEN 'IPM.Contact' THEN 'text/x-vcard' WHEN 'IPM.Note' THEN 'message/rfc822' WHEN 'IPM.Post' THEN 'text/plain' WHEN 'IPM.StickyNote' THEN 'text/plain' END AS mime FROM ({_CLASSES})) WHERE mime IS NOT NULL GROUP BY 1, 2")
def class_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = derive(spark, sf_dir, _CLASSES).select(text.mime_type(F.col("message_class")).alias("mime"))
    return out.where("mime is not null").groupBy("mime", text.extension(F.col("mime")).alias("ext")).agg(F.count(F.lit(1)).alias("n"))


@register(f"SELECT short, count(*) AS n FROM (SELECT CASE WHEN message_class LIKE '%IPM.%' THEN lower(regexp_extract(message_class, 'IPM\\.(.*)', 1)) END AS short FROM ({_CLASSES})) GROUP BY short")
def short_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, _CLASSES).groupBy(text.short_type(F.col("message_class")).alias("short")).agg(F.count(F.lit(1)).alias("n"))


_WALK = f"""WITH RECURSIVE nodes AS ({synth.NODES}), c AS ({synth.CUSTOMER_NODES}),
w(node_id, depth, path, display_name) AS (SELECT node_id, 0, '', display_name FROM nodes WHERE node_id = 33
 UNION ALL SELECT n.node_id, w.depth + 1, CASE WHEN w.depth = 0 THEN '' WHEN w.path = '' THEN w.display_name ELSE w.path || '/' || w.display_name END, n.display_name FROM w JOIN nodes n ON n.parent_id = w.node_id AND n.node_id <> n.parent_id)"""


def _folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = derive(spark, sf_dir, synth.NODES)
    return tree.walk(nodes, nodes.where("node_id = 33")).join(nodes.select("node_id", "display_name"), "node_id")


@register(f"{_WALK} SELECT node_id, CAST(depth AS INT) AS depth, path FROM w")
def folder_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folders(spark, sf_dir).select("node_id", "depth", "path")


_PLACES = "o AS (SELECT node_id, row_number() OVER (ORDER BY k) AS place FROM (SELECT w.node_id, CASE WHEN depth = 0 THEN '' WHEN depth = 1 THEN printf('%06d', w.node_id) ELSE printf('%06d', n.parent_id) || printf('%06d', w.node_id) END AS k FROM w JOIN nodes n ON w.node_id = n.node_id))"


@register(f"{_WALK}, {_PLACES} SELECT node_id, place FROM o")
def folder_preorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = derive(spark, sf_dir, synth.NODES)
    return tree.preorder(nodes, nodes.where("node_id = 33"))


_MESSAGES = f"{_WALK}, m AS (SELECT c.node_id, CASE WHEN w.path = '' THEN w.display_name ELSE w.path || '/' || w.display_name END AS path FROM c JOIN w ON c.parent_id = w.node_id)"


@register(f"{_MESSAGES} SELECT node_id, path FROM m WHERE lower(path) = 'asia' OR lower(path) LIKE 'asia/%'")
def path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders = _folders(spark, sf_dir).select(F.col("node_id").alias("parent_id"), F.concat_ws("/", text.empty_to_null(F.col("path")), "display_name").alias("path"))
    items = derive(spark, sf_dir, synth.CUSTOMER_NODES).join(folders.where(text.under_path(F.col("path"), F.lit("\\ASIA//"))), "parent_id")
    return items.select("node_id", "path")


@register(f"WITH nodes AS ({synth.NODES}) SELECT node_id, parent_id FROM nodes WHERE parent_id = node_id OR parent_id NOT IN (SELECT node_id FROM nodes)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.orphans(derive(spark, sf_dir, synth.NODES)).select("node_id", "parent_id")


@register(f"WITH n AS ({synth.NODES}), c AS ({synth.CUSTOMER_NODES}) SELECT parent_id, node_id, CAST(row_number() OVER (PARTITION BY parent_id ORDER BY ord, node_id) - 1 AS INT) AS place FROM (SELECT node_id, parent_id, ord FROM n UNION ALL SELECT node_id, parent_id, ord FROM c) x WHERE node_id <> parent_id AND parent_id IN (SELECT node_id FROM n)")
def child_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = derive(spark, sf_dir, synth.NODES).select("node_id", "parent_id", "ord")
    return tree.children(nodes.unionByName(derive(spark, sf_dir, synth.CUSTOMER_NODES).select("node_id", "parent_id", "ord")))


@register(f"WITH n AS ({synth.NODES}) SELECT node_id, CASE WHEN node_id = 33 THEN 'root' WHEN node_id = 101 THEN 'wastebasket' WHEN node_id % 3 = 0 OR node_id % 5 = 0 OR node_id % 7 = 0 THEN 'folder' ELSE 'message' END AS item_type FROM n")
def item_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("node_id")
    special = F.when(n == 33, "root").when(n == 101, "wastebasket")
    kind = tree.item_type(special, F.when(n % 3 == 0, 0), F.when(n % 5 == 0, 0), n % 7 == 0, F.lit(False))
    return derive(spark, sf_dir, synth.NODES).select("node_id", kind.alias("item_type"))


@register(f"WITH n AS ({synth.NODES}) SELECT CAST(33 AS BIGINT) AS parent_id, node_id FROM n WHERE parent_id = 102 UNION ALL SELECT 33, x FROM (VALUES (CAST(101 AS BIGINT)), (CAST(9999 AS BIGINT))) t(x) WHERE x NOT IN (SELECT node_id FROM n WHERE parent_id = 102)")
def root_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.reroot(tree.children(derive(spark, sf_dir, synth.NODES)), 102, [101, 9999], 33).select("parent_id", "node_id")


_PEOPLE = f"""WITH r AS ({synth.RECIPIENTS}), d AS (SELECT *, CASE WHEN regexp_matches(n0, '^''.*''') THEN regexp_extract(n0, '^''(.*)''', 1) ELSE n0 END AS rname,
 coalesce(smtp_address, org_email_addr, email_address) AS remail, CASE recipient_type WHEN 0 THEN 'orig' WHEN 1 THEN 'to' WHEN 2 THEN 'cc' WHEN 3 THEN 'bcc' END AS rtype
 FROM (SELECT *, coalesce(transmittable_display_name, display_name) AS n0 FROM r)), e AS (SELECT *, CASE WHEN coalesce(rname, '') <> '' AND remail IS NOT NULL AND rname <> remail THEN '"' || rname || '" <' || remail || '>' ELSE coalesce(remail, rname) END AS display FROM d)"""


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people.described(derive(spark, sf_dir, synth.RECIPIENTS))


@register(f"{_PEOPLE} SELECT rtype, display, count(*) AS n FROM e GROUP BY rtype, display")
def recipient_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _people(spark, sf_dir).groupBy("rtype", "display").agg(F.count(F.lit(1)).alias("n"))


@register(f"""{_PEOPLE} SELECT item_id, string_agg(display, ', ' ORDER BY ord, display) FILTER (rtype = 'to') AS "To", string_agg(display, ', ' ORDER BY ord, display) FILTER (rtype = 'cc') AS "Cc", string_agg(display, ', ' ORDER BY ord, display) FILTER (rtype = 'bcc') AS "Bcc" FROM e GROUP BY item_id""")
def recipient_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people.headers(_people(spark, sf_dir))


@register(f"{_PEOPLE} SELECT o_orderkey AS item_id, coalesce(x.expected, '') = CASE WHEN o_orderkey % 2 = 0 THEN coalesce(x.expected, '') ELSE '?' END AS agrees FROM orders LEFT JOIN (SELECT item_id, string_agg(display_name, '; ' ORDER BY ord, display_name) AS expected FROM e WHERE recipient_type = 1 GROUP BY item_id) x ON o_orderkey = x.item_id")
def display_to_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = derive(spark, sf_dir, synth.RECIPIENTS)
    listed = to.where("recipient_type = 1").groupBy("item_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "display_name"))), lambda x: x["display_name"]), "; ").alias("right"))
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id")).join(listed, "item_id", "left")
    items = items.select("item_id", F.when(F.col("item_id") % 2 == 0, F.col("right")).otherwise("?").alias("display_to"))
    return people.check_display_to(items, to).select("item_id", "agrees")


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = derive(spark, sf_dir, synth.NOTES)
    out = out.withColumn("transport", text.parse_headers(text.header_block(F.col("transport_headers"))))
    out = out.withColumn("date", messages.date_of(F.col("message_delivery_time"), F.col("creation_time")))
    return out.join(people.headers(_people(spark, sf_dir)), "item_id", "left")


_FROM = """CASE WHEN sender_addrtype = 'SMTP' THEN CASE WHEN sender_name IS NOT NULL AND sender_email_address IS NOT NULL AND sender_name <> sender_email_address THEN '"' || sender_name || '" <' || sender_email_address || '>' ELSE coalesce(sender_email_address, sender_name) END
 WHEN o_custkey IS NOT NULL AND item_id % 7 = 0 THEN 't' || o_custkey || '@example.com'
 WHEN sender_email_address IS NOT NULL THEN CASE WHEN sender_name IS NOT NULL THEN '"' || sender_name || '" <' || regexp_replace(sender_name, '(.*), (.*)', '\\2.\\1') ELSE '<' || lower(regexp_extract(sender_email_address, '(\\w+)$', 1)) END || '@' || CASE WHEN sender_email_address LIKE '/O=%' THEN 'acme.com' ELSE sender_email_address END || '>'
 WHEN sender_name IS NOT NULL THEN '"' || sender_name || '"' END"""
_NOTE = f"WITH notes AS (SELECT n.*, o.o_custkey FROM ({synth.NOTES}) n JOIN orders o ON n.item_id = o.o_orderkey), f AS (SELECT *, {_FROM} AS sender FROM notes)"


@register(f"{_NOTE} SELECT item_id, sender FROM f")
def from_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    sender = text.sender_address(F.col("sender_addrtype"), F.col("sender_name"), F.col("sender_email_address"), text.header_joined(F.col("transport"), "From"))
    return _notes(spark, sf_dir).select("item_id", sender.alias("sender"))


@register("SELECT o_orderkey AS item_id, strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S +0000') AS date FROM orders")
def date_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _notes(spark, sf_dir).select("item_id", text.rfc2822(F.col("date")).alias("date"))


_HEADERS = f"""{_NOTE}, {_PEOPLE.replace("WITH ", "")}, p AS (SELECT item_id AS pid, string_agg(display, ', ' ORDER BY ord, display) FILTER (rtype = 'to') AS t, string_agg(display, ', ' ORDER BY ord, display) FILTER (rtype = 'cc') AS c, string_agg(display, ', ' ORDER BY ord, display) FILTER (rtype = 'bcc') AS b FROM e GROUP BY item_id),
g AS (SELECT item_id, sender, o_custkey, concat_ws(chr(10), 'From: ' || sender, 'To: ' || t, 'Cc: ' || c, 'Bcc: ' || b, 'Subject: ' || subject, 'Date: ' || strftime(creation_time, '%a, %d %b %Y %H:%M:%S +0000'),
 'Message-ID: ' || internet_message_id, 'Importance: ' || nullif(CAST(importance AS STRING), '1'), 'Priority: ' || nullif(CAST(priority AS STRING), '1'), 'Sensitivity: ' || nullif(CAST(sensitivity AS STRING), '0'),
 'Thread-Topic: ' || conversation_topic, CASE WHEN read_receipt_requested THEN 'Disposition-Notification-To: ' || sender END) AS made FROM f LEFT JOIN p ON f.item_id = p.pid)"""


@register(f"{_HEADERS} SELECT item_id, made FROM g")
def mapped_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = _notes(spark, sf_dir)
    made = messages.generated_headers(notes)
    return notes.select("item_id", F.array_join(F.transform(made, lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n").alias("made"))


@register(f"{_HEADERS} SELECT item_id, made || CASE WHEN item_id % 7 = 0 THEN CASE WHEN sender IS NULL THEN chr(10) || 'From: t' || o_custkey || '@example.com' ELSE '' END || chr(10) || 'X-Seen: a b c' || chr(10) || 'X-Seen: two' ELSE '' END || chr(10) || 'Content-Type: text/plain' AS merged FROM g")
def merged_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = _notes(spark, sf_dir)
    content = F.array(F.struct(F.lit("Content-Type").alias("name"), F.lit("text/plain").alias("value")))
    merged = messages.merged_headers(messages.generated_headers(notes), F.col("transport"), content)
    return notes.select("item_id", F.array_join(F.transform(merged, lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n").alias("merged"))


@register(f"{_HEADERS} SELECT item_id, sha256(replace(made || CASE WHEN item_id % 7 = 0 THEN CASE WHEN sender IS NULL THEN chr(10) || 'From: t' || o_custkey || '@example.com' ELSE '' END || chr(10) || 'X-Seen: a b c' || chr(10) || 'X-Seen: two' ELSE '' END || chr(10) || 'Content-Type: text/plain', chr(10), chr(13) || chr(10)) || chr(13) || chr(10) || chr(13) || chr(10) || 'Body of ' || item_id) AS mime FROM g")
def note_mime(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    notes = _notes(spark, sf_dir).withColumns({"text_body": F.concat(F.lit("Body of "), "item_id"), "rtf_body": none, "html_body": none})
    return messages.to_mime(notes).select("item_id", F.sha2("mime", 256).alias("mime"))


@register("SELECT doc_id, CAST(2 AS BIGINT) AS n, lang AS main, 'src=' || source || ';' || CAST(n_chars AS STRING) AS shown FROM documents")
def header_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = F.concat(F.lit("X-Main:\t"), "lang", F.lit('; src="'), "source", F.lit('"; SRC2=x; n='), F.col("n_chars").cast("string"), F.lit("; n=dup\r\nX-Other: a\r\n  b\r\nnot a header\r\n\r\n"), "text")
    docs = table(spark, sf_dir, "documents").select("doc_id", text.parse_headers(text.header_block(block)).alias("h"))
    main = text.header_joined(F.col("h"), "X-Main")
    attributes = text.header_attributes(main)
    return docs.select("doc_id", F.size("h").cast("long").alias("n"), text.header_main(main).alias("main"), F.concat(F.lit("src="), attributes["src"], F.lit(";"), attributes["n"]).alias("shown"))


@register("SELECT doc_id, CASE WHEN text || lang IS NOT NULL THEN 'intro' END AS preamble, CASE WHEN lang IS NOT NULL THEN text END AS first, CASE WHEN text IS NOT NULL THEN lang END AS second, CASE WHEN text || lang IS NOT NULL THEN 'end' END AS epilogue FROM documents")
def multipart_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with a mark that does not occur in the text. A null text or language makes the whole body null."""
    docs = table(spark, sf_dir, "documents").withColumn("mark", F.concat(F.lit("==b"), F.sha2("text", 256)))
    line = F.concat(F.lit("\r\n--"), "mark")
    body = F.concat(F.lit("intro"), line, F.lit("\r\n"), "text", line, F.lit("\r\n"), "lang", line, F.lit("--\r\nend"))
    return docs.withColumn("p", text.split_multipart(body, F.col("mark"), built=False)).select("doc_id", "p.preamble", F.element_at("p.parts", 1).alias("first"), F.element_at("p.parts", 2).alias("second"), "p.epilogue")


@register("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'from rtf' ELSE text END AS body FROM documents")
def body_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: a null, empty or blank text without an RTF stays as it is."""
    from .functions import rtf

    packed = rtf.compress(rb"{\rtf1\ansi from rtf}")
    docs = table(spark, sf_dir, "documents")
    docs = docs.withColumns({"body": F.when(F.col("doc_id") % 4 == 0, F.lit(" \n")).otherwise(F.col("text")), "rtf_compressed": F.when(F.col("doc_id") % 4 == 0, F.lit(packed)), "body_html": F.lit(None).cast("string")})
    return messages.with_bodies(docs).select("doc_id", F.col("text_body").alias("body"))


#: Mails of three levels: a boundary that starts another one, one inside a line, a part without headers, a fifth not closed.
_MIXED = """SELECT doc_id, concat('Subject: ', lang, e, 'content-type: multipart/mixed; boundary="', m, '"', e, e, 'pre', e, '--', m, e,
 'Content-Type: multipart/alternative;', e, chr(9), 'boundary=', m, '.1', e, e, '--', m, '.1', e, 'Content-Type: Text/Plain; charset=x', e, e, 'say --', m, ' inside', e, body, e, '--', m, '.1  ', e,
 'Content-Type: multipart/related; boundary="', m, '.1.x"', e, e, '--', m, '.1.x', e, e, source, e, '--', m, '.1.x--', e, '--', m, '.1--', e, e, '--', m, e, e, lang,
 CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat(e, '--', m, '--', e, 'end') END) AS text
 FROM (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS body, concat('=b', md5(concat('part', CAST(doc_id AS STRING)))) AS m, concat(chr(13), chr(10)) AS e FROM documents) x"""


@register("""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS body, '=b' || md5('part' || doc_id) AS m, chr(13) || chr(10) AS e FROM documents),
 r AS (SELECT doc_id, '' AS path, 'multipart/mixed' AS content_type, 2 AS n_headers, NULL AS body, 'pre' AS preamble, CASE WHEN doc_id % 5 <> 0 THEN 'end' END AS epilogue, CASE WHEN doc_id % 5 = 0 THEN 'not closed' END AS note FROM d
 UNION ALL SELECT doc_id, '1', 'multipart/alternative', 1, NULL, '', '', NULL FROM d UNION ALL SELECT doc_id, '1/1', 'text/plain', 1, 'say --' || m || ' inside' || e || body, NULL, NULL, NULL FROM d
 UNION ALL SELECT doc_id, '1/2', 'multipart/related', 1, NULL, '', '', NULL FROM d UNION ALL SELECT doc_id, '1/2/1', NULL, 0, source, NULL, NULL, NULL FROM d UNION ALL SELECT doc_id, '2', NULL, 0, lang, NULL, NULL, NULL FROM d)
 SELECT doc_id, path, content_type, n_headers, sha256(body) AS body, preamble, epilogue, note FROM r""")
def part_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mime.part_tree(derive(spark, sf_dir, _MIXED), ["doc_id"])
    return out.select("doc_id", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), "content_type", F.size("headers").alias("n_headers"), F.sha2("body", 256).alias("body"), "preamble", "epilogue", "note")


@register(r"""SELECT doc_id, CAST(2 AS INT) AS n_headers, lang AS subject, 'Thu, 01 Jan 1970 00:00:00 +0000' AS date, sha256(CASE WHEN ends_with(cut, chr(13)) THEN cut || chr(10) ELSE cut END) AS body
 FROM (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS body, rtrim(coalesce(text, ''), chr(10)) AS cut FROM documents)""")
def mbox_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as one mbox for each source, whose lines that look like separators are quoted, and read again."""
    from .sources import mail, sinks

    path = fresh_path(spark, "boxes")
    entry = F.concat(F.lit("X-Id: "), F.col("doc_id").cast("string"), F.lit("\r\nSubject: "), F.coalesce("lang", F.lit("")), F.lit("\r\n\r\n"), F.coalesce("text", F.lit("")))
    boxes = table(spark, sf_dir, "documents").select(F.concat(F.coalesce("source", F.lit("none")), F.lit(".mbox")).alias("out_name"), F.col("doc_id").alias("ord"), sinks.mbox_entry(entry, F.lit(None).cast("timestamp")).alias("content"))
    sinks.write_combined(boxes, path)
    mails = mail.parsed(mail.read_mbox(spark, path))
    value = lambda name: text.header_joined(F.col("headers"), name)
    return mails.select(value("X-Id").cast("long").alias("doc_id"), F.size("headers").alias("n_headers"), F.coalesce(value("Subject"), F.lit("")).alias("subject"), F.regexp_replace("separator", r"^\S+ ", "").alias("date"), F.sha2("body", 256).alias("body"))


@register("WITH a AS (SELECT o_orderkey AS k, 1 AS code, o_orderstatus AS v FROM orders), b AS (SELECT l_orderkey AS k, CAST(l_linenumber AS INT) AS code, max(l_returnflag) AS v FROM lineitem GROUP BY 1, 2) SELECT coalesce(a.k, b.k) AS item_id, coalesce(a.code, b.code) AS code, CASE WHEN b.k IS NOT NULL THEN b.v ELSE a.v END AS value FROM a FULL JOIN b ON a.k = b.k AND a.code = b.code")
def attachment_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.lit(1).alias("code"), F.col("o_orderstatus").alias("value"))
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("code")).agg(F.max("l_returnflag").alias("value"))
    return messages.overlay(rows, own, ["item_id", "code"])


@register("""SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END AS filename, p_partkey % 3 = 0 AS related, 'Content-Type: ' || CASE WHEN p_partkey % 5 = 0 THEN 'image/png' ELSE 'application/octet-stream' END || chr(13) || chr(10) ||
 'Content-Disposition: attachment; filename="' || CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END || '"' || chr(13) || chr(10) || 'Content-Transfer-Encoding: base64' || chr(13) || chr(10) ||
 CASE WHEN p_partkey % 3 = 0 THEN 'Content-ID: <' || p_partkey || '>' || chr(13) || chr(10) ELSE '' END || chr(13) || chr(10) || regexp_replace(base64(encode(p_type || p_name || p_type || p_name || p_type)), '(.{1,60})', '\\1' || chr(13) || chr(10), 'g') AS part FROM part""")
def attachment_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, none = F.col("p_partkey"), F.lit(None).cast("string")
    rows = table(spark, sf_dir, "part").select(
        k.alias("id"), F.when(k % 2 == 0, F.col("p_name")).alias("attach_long_filename"), F.col("p_brand").alias("attach_filename"), F.when(k % 5 == 0, "image/png").alias("attach_mime_tag"),
        F.when(k % 3 == 0, F.concat(F.lit("<"), k, F.lit(">"))).alias("attach_content_id"), none.alias("attach_content_location"), none.alias("embedded_mime"), none.alias("embedded_subject"),
        F.encode(F.concat("p_type", "p_name", "p_type", "p_name", "p_type"), "UTF-8").alias("attach_data"),
    )
    return messages.attachment_parts(rows).select("id", "filename", "related", "part")


_ESCAPE = "replace(replace(replace(replace({0}, chr(92), chr(92) || chr(92)), ',', chr(92) || ','), ';', chr(92) || ';'), chr(10), chr(92) || 'n')"


def _card(column: str) -> str:
    return _ESCAPE.format(column)


_FOLD = "substring(line, 1, 75) || regexp_replace(substring(line, 76), '(.{1,74})', chr(10) || ' \\1', 'g')"


@register(f"""{_ONE}, r AS (SELECT item_id, {", ".join(f"max(CASE WHEN symbol = '{s}' THEN value END) AS {s}" for s in _RECORD)} FROM one GROUP BY item_id),
l AS (SELECT item_id, 0 AS k, 'BEGIN:VCARD' AS line FROM r UNION ALL SELECT item_id, 1, 'VERSION:3.0' FROM r UNION ALL SELECT item_id, 2, 'N:' || {_card('surname')} || ';' || {_card('given_name')} || ';;;' FROM r
 UNION ALL SELECT item_id, 3, 'FN:' || {_card('subject')} FROM r UNION ALL SELECT item_id, 4, 'ADR;TYPE=work:;;;' || {_card("(business_address_city || ', ' || business_address_state)")} || ';;;' FROM r
 UNION ALL SELECT item_id, 5, 'X-EVOLUTION-FILE-AS:' || {_card('file_under')} FROM r UNION ALL SELECT item_id, 6, CASE WHEN email_addr_type = 'SMTP' THEN 'EMAIL:' ELSE 'EMAIL;TYPE=x400:' END || email_email_address FROM r
 UNION ALL SELECT item_id, 7, 'ORG:' || {_card('company_name')} FROM r UNION ALL SELECT item_id, 8, 'END:VCARD' FROM r)
SELECT item_id, string_agg({_FOLD}, chr(10) ORDER BY k) || chr(10) AS card FROM l GROUP BY item_id""")
def vcard_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = properties.to_records(_one(spark, sf_dir), _RECORD)
    return records.select("item_id", messages.vcard({s: F.col(s) for s in _RECORD}).alias("card"))


@register(f"SELECT doc_id, {_card('text')} AS escaped FROM documents")
def vcard_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.vcard_escape(F.col("text")).alias("escaped"))


@register("SELECT doc_id, regexp_replace('From a' || chr(10) || '>From ' || text || chr(10) || 'Fromage', '(?m)^(>*From )', '>\\1', 'g') AS quoted FROM documents")
def mbox_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("From a\n>From "), "text", F.lit("\nFromage"))
    return table(spark, sf_dir, "documents").select("doc_id", text.mboxrd(body).alias("quoted"))


@register("SELECT p_partkey AS id, regexp_replace(p_name || ' (' || p_type || ').eml', '[^A-Za-z0-9.()\\[\\]{}-]', '_', 'g') AS safe, regexp_replace(regexp_replace(translate('Top/' || p_type, ' /', '_.'), '[^A-Za-z0-9.()\\[\\]{}-]', '_', 'g') || '..mbox', '\\.+', '.', 'g') AS combined FROM part")
def filename_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_name", F.lit(" ("), "p_type", F.lit(").eml"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.safe_filename(name).alias("safe"), text.combined_filename(F.concat(F.lit("Top/"), "p_type"), F.lit("Mail.mbox")).alias("combined"))


#: Names that repeat, and names that look like numbered ones: those of every ninth part are a brand's name with a number.
_NAMES = "SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN concat(p_brand, '.', CAST(2 + p_partkey % 23 AS INT), '.eml') ELSE concat(p_brand, '.eml') END AS name FROM part"


@register(rf"""WITH n AS ({_NAMES}), p AS (SELECT id, name, row_number() OVER (PARTITION BY name ORDER BY id) AS place FROM n),
 free AS (SELECT base, k, row_number() OVER (PARTITION BY base ORDER BY k) + 1 AS place FROM (SELECT name AS base, unnest(range(2, CAST(count(*) + 40 AS BIGINT))) AS k FROM n GROUP BY name) WHERE regexp_replace(base, '(\.[^.]+)$', '.' || k || '\1') NOT IN (SELECT name FROM n))
 SELECT p.id, CASE WHEN p.place = 1 THEN p.name ELSE regexp_replace(p.name, '(\.[^.]+)$', '.' || free.k || '\1') END AS filename FROM p LEFT JOIN free ON free.base = p.name AND free.place = p.place""")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.sinks import unique_filenames

    return unique_filenames(derive(spark, sf_dir, _NAMES), "name", "id").select("id", "filename")


_RANGES = "SELECT l_orderkey AS file_id, CAST(l_linenumber * 200 + l_partkey % 50 AS BIGINT) AS offset_, CAST(l_quantity * 5 AS BIGINT) AS size FROM lineitem"


@register(f'SELECT file_id, offset_ AS "offset", size, size + (64 - size % 64) % 64 AS padded, coalesce(lead(offset_) OVER (PARTITION BY file_id ORDER BY offset_, size) - (offset_ + size + (64 - size % 64) % 64), -9999) AS gap FROM ({_RANGES})')
def range_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.range_gaps(derive(spark, sf_dir, _RANGES).withColumnRenamed("offset_", "offset")).withColumn("gap", _or(-9999, "gap"))


_NODE = "SELECT CAST(o_custkey % 8 AS BIGINT) AS file_id, o_orderkey AS node_id, o_orderkey * 4 AS data_block, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey * 4 + 2 ELSE 0 END AS sub_block FROM orders"
_BLOCK = "SELECT DISTINCT CAST(o_custkey % 8 AS BIGINT) AS file_id, o_orderkey * 4 + x AS block_id, o_orderkey * 1000 + x AS offset_, o_orderkey % 8000 AS size FROM orders CROSS JOIN (SELECT 0 AS x UNION ALL SELECT 2) t WHERE o_orderkey % 5 <> 0"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = F.explode(F.array(F.lit(0), F.lit(2))).alias("x")
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").where(k % 5 != 0).select((F.col("o_custkey") % 8).alias("file_id"), k, pair).select("file_id", (k * 4 + F.col("x")).alias("block_id"), (k * 1000 + F.col("x")).alias("offset"), (k % 8000).alias("size"))


@register(f"WITH n AS ({_NODE}), b AS ({_BLOCK}) SELECT n.node_id, coalesce(d.offset_, -1) AS data_offset, coalesce(d.size, -1) AS data_size, coalesce(s.offset_, -1) AS sub_offset, coalesce(s.size, -1) AS sub_size FROM n LEFT JOIN b d ON n.file_id = d.file_id AND n.data_block = d.block_id LEFT JOIN b s ON n.file_id = s.file_id AND n.sub_block = s.block_id")
def node_block_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = store.node_blocks(derive(spark, sf_dir, _NODE), _blocks(spark, sf_dir))
    return out.select("node_id", *[_or(-1, c) for c in ("data_offset", "data_size", "sub_offset", "sub_size")])


_SUB = "SELECT CAST(o_custkey % 8 AS BIGINT) AS file_id, l_orderkey AS owner, CAST(1649 + l_linenumber % 3 AS BIGINT) AS id2, l_orderkey * 4 AS block_id, l_linenumber AS ord FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


@register(f"WITH s AS ({_SUB}), b AS ({_BLOCK}), f AS (SELECT file_id, owner, id2, arg_min(block_id, ord) AS block_id FROM s WHERE id2 = 1649 GROUP BY 1, 2, 3) SELECT f.file_id, f.owner, f.block_id, b.offset_ AS \"offset\" FROM f JOIN b ON f.file_id = b.file_id AND f.block_id = b.block_id")
def subnode_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.sub_blocks(derive(spark, sf_dir, _SUB), _blocks(spark, sf_dir), 0x671).select("file_id", "owner", "block_id", "offset")


@register("SELECT kind, count(*) AS n FROM (SELECT CASE WHEN (l_orderkey & 2) = 0 THEN 'data' WHEN l_linenumber = 1 THEN 'chain' WHEN l_linenumber = 2 THEN 'submap' ELSE 'unknown' END AS kind FROM lineitem) GROUP BY kind")
def block_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(store.block_kind(F.col("l_orderkey"), F.col("l_linenumber")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


#: Orders of eight files as blocks: block k of a file lists blocks 2k and 2k + 1, so that chains are as deep as the file is long, and
#: block 3 lists block 1, inside which it stands.
_TREES = "SELECT CAST(o_custkey % 8 AS BIGINT) AS file_id, CAST(row_number() OVER (PARTITION BY o_custkey % 8 ORDER BY o_orderkey) AS BIGINT) AS k FROM orders"


@register(f"""WITH RECURSIVE b AS ({_TREES}), c(head_id, file_id, k, path) AS (SELECT k, file_id, k, '' FROM b WHERE k = 1 UNION ALL SELECT c.head_id, c.file_id, b.k, c.path || CASE WHEN b.k % 2 = 0 THEN '0' ELSE '1' END FROM c JOIN b ON c.file_id = b.file_id AND b.k // 2 = c.k)
 SELECT c.file_id, c.head_id, c.k AS block_id, CAST(row_number() OVER (PARTITION BY c.file_id ORDER BY path) - 1 AS INT) AS place FROM c WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.file_id = c.file_id AND b.k = 2 * c.k)""")
def chain_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = written(derive(spark, sf_dir, _TREES), "blocks")
    links = blocks.where("k > 1").select("file_id", F.floor(F.col("k") / 2).alias("block_id"), F.col("k").alias("place"), F.col("k").alias("child_id"))
    links = links.unionByName(blocks.where("k = 3").select("file_id", F.col("k").alias("block_id"), F.lit(0).cast("long").alias("place"), F.lit(1).cast("long").alias("child_id")))
    return store.expand_chains(blocks.where("k = 1").select("file_id", F.col("k").alias("head_id")), links, ["file_id"]).select("file_id", "head_id", "block_id", "place")


@register("SELECT l_orderkey AS head_id FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT (l_partkey & 2)) > 1")
def mixed_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.mixed_flags(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("head_id"), F.col("l_partkey").alias("block_id")))


@register("SELECT doc_id AS table_id, CAST(i AS INT) AS row, substring(lang || source || lang || source || 'xx', CAST(i * 5 + 2 AS BIGINT), 2) AS cell FROM (SELECT doc_id, lang, source, unnest(range(0, length(lang || source || lang || source || 'xx') // 5)) AS i FROM documents)")
def table_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("table_id"), F.encode(F.concat("lang", "source", "lang", "source", F.lit("xx")), "UTF-8").alias("data"), F.lit(5).alias("rec_size"))
    return store.table_rows(tables).select("table_id", "row", F.decode(store.project(F.col("record"), 1, 2), "UTF-8").alias("cell"))


@register("SELECT l_orderkey AS table_id, CAST(sum(l_linenumber) AS BIGINT) AS least_size FROM lineitem GROUP BY l_orderkey")
def least_record_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.least_record_size(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("size")))


@register("SELECT user_id AS item_id, max(CASE WHEN event_id % 2 = 0 THEN ts ELSE ts - INTERVAL 1 DAY END) AS latest FROM events GROUP BY user_id")
def latest_stream_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("item_id"), F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("modified"), (F.col("ts") - F.expr("INTERVAL 1 DAY")).alias("created"))
    return store.latest_time(rows)


@register(f"SELECT id % 40 AS object_id, count(*) FILTER (id % 5 <> 4) > 2 AS is_message FROM ({_STREAMS}) GROUP BY 1")
def embedded_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.embedded_kind(derive(spark, sf_dir, _STREAMS).select((F.col("id") % 40).alias("object_id"), "name"))


def _le(column: str, size: int):
    """Little-endian bytes of a number column, its lowest `size`, for queries over bytes."""
    digits = F.lpad(F.hex(F.col(column).cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(size)]))


@register("SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_partkey * 65536 + 30 AS BIGINT) AS tag, CAST(l_partkey & 65535 AS INT) AS code, 30 AS type, printf('%04x', l_linenumber) AS hex FROM lineitem")
def little_endian(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", _le("l_partkey", 7).alias("b"))
    rows = rows.select("l_orderkey", "l_linenumber", binary.le_uint(F.col("b")).cast("long").alias("l_partkey"))
    tag = (F.col("l_partkey") * 65536 + 30).alias("tag")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", tag, binary.tag_code(F.col("l_partkey") * 65536).alias("code"), binary.tag_type(F.col("l_partkey") * 65536 + 30).alias("type"), binary.hex4(F.col("l_linenumber")).alias("hex"))


@register("SELECT c_custkey AS id, printf('%08x', c_custkey) || '-0000-0000-c000-000000000046' AS guid FROM customer")
def guid_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.concat(_le("c_custkey", 4), F.unhex(F.lit("00000000C000000000000046")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), binary.guid_text(data).alias("guid"))


@register("SELECT event_id, ts FROM events")
def filetime_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = F.unix_micros(F.col("ts").cast("timestamp")) * 10 + F.lit(binary.FILETIME_EPOCH)
    return table(spark, sf_dir, "events").select("event_id", binary.filetime(ticks).cast("timestamp_ntz").alias("ts"))


@register("SELECT doc_id, text, 'x' AS chomped, base64(encode(source)) || chr(13) || chr(10) AS b64 FROM documents")
def text_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", binary.utf16(F.encode("text", "UTF-16LE")).alias("text"), binary.chomp_nul(F.lit("x\x00")).alias("chomped"), binary.base64_lines(F.encode("source", "UTF-8")).alias("b64"))


@register("SELECT o_orderkey AS ref, CASE WHEN o_orderkey = 0 THEN 'none' WHEN o_orderkey % 16 = 15 THEN 'subnode' WHEN o_orderkey % 32 <> 0 THEN 'bad' ELSE 'heap' END AS kind, CASE WHEN o_orderkey % 32 = 0 AND o_orderkey <> 0 THEN CAST(o_orderkey // 65536 AS INT) ELSE -1 END AS block, CASE WHEN o_orderkey % 32 = 0 AND o_orderkey <> 0 THEN CAST((o_orderkey // 16 % 4096) // 2 AS INT) ELSE -1 END AS slot FROM orders")
def heap_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ref"), binary.heap_reference(F.col("o_orderkey")).alias("r")).select("ref", "r.kind", _or(-1, "r.block"), _or(-1, "r.slot"))


@register("SELECT c_custkey AS id, c_custkey AS node_id, 'Class' || c_nationkey AS class_name FROM customer")
def entry_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.concat(F.unhex(F.lit("00" * 20)), _le("c_custkey", 4))
    stream = F.encode(F.concat(F.lit("0" * 32), F.lit("Class"), F.col("c_nationkey").cast("string"), F.lit("\x00rest")), "ISO-8859-1")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), binary.entry_id_node(entry).alias("node_id"), binary.class_name(stream).alias("class_name"))


@register("SELECT doc_id, lang || '|' || source || '|' || lang AS pieces FROM documents")
def multi_value_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.lit(3).alias("n"), F.lit(16).alias("o1"), (F.octet_length("lang") + 16).alias("o2"), (F.octet_length("lang") + F.octet_length("source") + 16).alias("o3"))
    data = F.concat(_le("n", 4), _le("o1", 4), _le("o2", 4), _le("o3", 4), F.encode(F.concat("lang", "source", "lang"), "UTF-8"))
    return docs.select("doc_id", F.array_join(F.transform(binary.multi_value(data), lambda b: F.decode(b, "UTF-8")), "|").alias("pieces"))


def _number(value, size: int):
    """Little-endian bytes of a number."""
    pad = F.lpad(F.hex((F.lit(value) if isinstance(value, int) else value).cast("long")), 2 * size, "0")
    return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(pad, F.lit("(..)"), F.lit(1))), ""))


#: Lines of orders, each number once.
_LINES = "SELECT l_orderkey AS id, CAST(l_linenumber AS INT) AS line, max(l_partkey) AS part, max(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey, l_linenumber"


@register(f"""SELECT id, CASE WHEN note IS NULL THEN value END AS value, n_bytes, note FROM (SELECT id, value, n_bytes, CASE WHEN coded > 0 AND coded < n THEN 'mixed encryption' WHEN n_bytes > 24 THEN 'too long' END AS note
 FROM (SELECT id, string_agg(flag || part, '' ORDER BY line) AS value, CAST(sum(length(flag || part)) AS BIGINT) AS n_bytes, count(*) FILTER (id % 10 = 0 AND line = 2) AS coded, count(*) AS n FROM ({_LINES}) GROUP BY id))""")
def chained_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values in pieces put together up to 24 bytes; every tenth order has a block of the other kind among its pieces."""
    data = F.encode(F.concat("flag", F.col("part").cast("string")), "UTF-8")
    rows = derive(spark, sf_dir, _LINES).select("id", F.col("line").alias("place"), (F.col("part") * 4 + F.when((F.col("id") % 10 == 0) & (F.col("line") == 2), 2).otherwise(0)).alias("block_id"), data.alias("data"))
    out = store.concatenated(rows.withColumn("size", F.octet_length("data").cast("long")), ["id"], 24)
    return out.select("id", F.decode("data", "UTF-8").alias("value"), "n_bytes", "note")


@register(f"""WITH l AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY line) - 1 AS INT) AS row FROM ({_LINES}))
 SELECT id, row, 3592 AS code, part AS raw, '' AS wide FROM l UNION ALL SELECT id, row, 3093, CAST(line AS BIGINT), '' FROM l WHERE id % 2 = 0
 UNION ALL SELECT id, row, 12289, -1, rpad(flag, 8, 'x') FROM l WHERE id % 2 = 1 UNION ALL SELECT id, row, 3599, CAST(line % 2 AS BIGINT), '' FROM l WHERE id % 2 = 1""")
def described_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of two layouts, read by the descriptors that each carries: orders are tables and their lines records."""
    even = F.col("id") % 2 == 0
    short = F.concat(_number(F.col("part"), 4), _number(F.col("line"), 2))
    long = F.concat(_number(F.col("line") % 2, 1), F.unhex(F.lit("00")), F.encode(F.rpad("flag", 8, "x"), "UTF-8"), _number(F.col("part"), 4), F.unhex(F.lit("0000")))
    rows = derive(spark, sf_dir, _LINES).select("id", "line", F.when(even, short).otherwise(long).alias("record"))
    # type, code, offset, size and slot of each column
    layouts = [bytes.fromhex("0300080E00000400" "0200150C04000201"), bytes.fromhex("1E00013002000800" "0B000F0E00000101" "0300080E0A000402")]
    tables = rows.groupBy(F.col("id").alias("table_id")).agg(F.expr("listagg(record) WITHIN GROUP (ORDER BY line)").alias("data"))
    first = F.col("table_id") % 2 == 0
    tables = tables.select("table_id", "data", F.when(first, 6).otherwise(16).alias("rec_size"), F.when(first, F.lit(layouts[0])).otherwise(F.lit(layouts[1])).alias("schema"))
    cells = store.cells(store.table_rows(tables), store.column_descriptors(tables, ["table_id"]), ["table_id"])
    return cells.select(F.col("table_id").alias("id"), "row", "code", _or(-1, "raw"), F.when(F.col("raw").isNull(), F.decode("cell", "UTF-8")).otherwise("").alias("wide"))


def _customer_stores(spark: SparkSession, sf_dir: str):
    """Each customer as a store of one node: a heap block with a property list, and a sub-node with a longer text. That of every
    seventh customer says it is longer than the file; every eleventh's isn't there."""
    from .sources import store_frames

    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.encode("c_name", "UTF-8").alias("name"), F.encode("c_mktsegment", "UTF-16LE").alias("wide"), F.encode("c_mktsegment", "UTF-8").alias("segment"), F.encode(F.repeat("c_name", 3), "UTF-8").alias("body"))
    ref = lambda slot: F.lit(slot << 5)
    entries = [
        (0x0037, 0x1E, ref(3)), (0x0017, 3, F.pmod(-F.col("k"), F.lit(1 << 32))), (0x0E06, 0x40, ref(4)), (0x3001, 0x1F, ref(5)), (0x802B, 0x101E, ref(6)), (0x1000, 0x1E, F.lit(0x700F)),
        (0x0029, 0x0B, F.col("k") % 2), (0x0070, 0x1E, F.lit(0x11)), (0x007D, 0x1E, F.lit(0)), (0x1013, 0x0102, ref(9)), (0x3602, 2, F.lit(65535)),
    ]
    tuples = F.concat(*[F.concat(_number(code, 2), _number(kind, 2), _number(raw, 4)) for code, kind, raw in entries])
    values = [
        F.concat(_number(0x000602B5, 4), _number(ref(2), 4)), tuples, F.col("name"), _number(F.lit(binary.FILETIME_EPOCH) + F.col("k") * 10_000_000, 8), F.col("wide"),
        F.concat(_number(2, 4), _number(12, 4), _number(F.octet_length("name") + 12, 4), F.col("name"), F.col("segment")),
    ]
    ends = [F.lit(8)]
    for v in values:
        ends.append(ends[-1] + F.octet_length(v))
    heap = F.concat(_number(ends[-1], 2), _number(0xBCEC, 2), _number(ref(1), 4), *values, _number(len(values), 2), _number(0, 2), *[_number(e, 2) for e in ends])
    made = written(c.select(F.col("k").cast("string").alias("file"), "k", heap.alias("heap"), "body"), "stores")
    size = F.octet_length("heap").cast("long")
    blocks = made.select("file", F.lit(4).cast("long").alias("block_id"), F.lit(0).cast("long").alias("offset"), size.alias("size"))
    blocks = blocks.unionByName(made.where("k % 11 <> 0").select("file", F.lit(8).cast("long").alias("block_id"), size.alias("offset"), (F.octet_length("body") + F.when(F.col("k") % 7 == 0, 10).otherwise(0)).cast("long").alias("size")))
    nodes = made.select("file", F.col("k").alias("node_id"), F.lit(4).cast("long").alias("data_block"), F.lit(6).cast("long").alias("sub_block"), F.lit(33).cast("long").alias("parent_id"))
    maps = made.select("file", F.lit(6).cast("long").alias("owner"), F.lit(0x700F).cast("long").alias("id2"), F.lit(8).cast("long").alias("block_id"))
    heads = made.select("file", F.lit(False).alias("wide"), F.lit(0).alias("encryption"))
    cut = made.select("file", F.lit(0).alias("seg"), F.concat("heap", "body").alias("data"))
    none = spark.createDataFrame([], "file string, block_id long, place long, child_id long")
    tables = store_frames.Relations(heads, heads.where("false"), cut, blocks, nodes, Notes(), links=none, maps=maps)
    heaps = nodes.select("file", "node_id", F.lit("message").alias("owner"), F.lit(-1).alias("child_ix"), F.col("data_block").alias("head_block"), F.col("sub_block").alias("owner_map"))
    return tables, store_frames.heap_values(tables, heaps)


@register("""SELECT c_custkey AS id, code, value FROM customer, (VALUES (55), (23), (3590), (12289), (32811), (4096), (41), (112), (125), (4115), (13826)) t(code), LATERAL (SELECT CASE code WHEN 55 THEN c_name WHEN 23 THEN CAST(-c_custkey AS VARCHAR) WHEN 3590 THEN CAST(c_custkey AS VARCHAR) WHEN 12289 THEN c_mktsegment
 WHEN 32811 THEN c_name || '|' || c_mktsegment WHEN 4096 THEN CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_name || c_name || c_name END WHEN 41 THEN CASE WHEN c_custkey % 2 = 1 THEN 'true' ELSE 'false' END WHEN 112 THEN '' WHEN 4115 THEN '' WHEN 13826 THEN '-1' END AS value) v""")
def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the bytes of blocks to typed values, by joins: chunks, slots, references, sub-nodes."""
    _, found = _customer_stores(spark, sf_dir)
    value = F.coalesce("v_str", F.col("v_int").cast("string"), F.col("v_bool").cast("string"), F.unix_seconds("v_ts").cast("string"), F.array_join("v_arr", "|"), F.hex("v_bin"))
    return found.select(F.col("node_id").alias("id"), "code", value.alias("value"))


@register("SELECT code, count(*) AS n FROM (SELECT 'bad reference' AS code FROM customer UNION ALL SELECT 'bad reference' FROM customer UNION ALL SELECT 'no block' FROM customer WHERE c_custkey % 11 = 0 UNION ALL SELECT 'short read' FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 11 <> 0) GROUP BY code")
def store_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was odd in the stores of typed_values, told from the steps' own tables."""
    tables, _ = _customer_stores(spark, sf_dir)
    return tables.notes.rows(spark).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@register("""WITH l AS (SELECT *, l_quantity <= 40 AS a, l_discount < 0.08 AS b, l_shipdate IS NOT NULL AND l_extendedprice > 2000 AS c FROM lineitem)
 SELECT 'good' AS rule, count(*) AS n FROM l WHERE a AND b AND c UNION ALL SELECT 'quantity', count(*) FROM l WHERE NOT a UNION ALL SELECT 'discount', count(*) FROM l WHERE NOT b UNION ALL SELECT 'price', count(*) FROM l WHERE NOT c""")
def checked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"quantity": F.col("l_quantity") <= 40, "discount": F.col("l_discount") < 0.08, "price": F.col("l_shipdate").isNotNull() & (F.col("l_extendedprice") > 2000)}
    good, bad, _ = checked(table(spark, sf_dir, "lineitem"), rules)
    return bad.select(F.explode("broken").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n")).unionByName(good.agg(F.lit("good").alias("rule"), F.count(F.lit(1)).alias("n")))


@register(f"""SELECT id, 32768 + line AS pseudo, coalesce(CASE WHEN line % 2 = 1 THEN CAST(part % 65536 AS INT) END, -1) AS code, CASE WHEN line % 2 = 0 THEN 'Näme ' || part END AS name,
 CASE line % 4 WHEN 0 THEN '{names.PS_MAPI}' WHEN 1 THEN '{names.PS_PUBLIC_STRINGS}' WHEN 2 THEN '{names.PSETID_ADDRESS}' ELSE printf('%08x', id) || '-0000-0000-c000-000000000046' END AS guid FROM ({_LINES})""")
def name_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three streams of a message file's name map, built from the lines of an order and decoded again."""
    from pyspark.sql import Window

    named = F.col("line") % 2 == 0
    text16 = F.encode(F.concat(F.lit("Näme "), F.col("part").cast("string")), "UTF-16LE")
    piece = F.when(named, F.concat(_number(F.octet_length(text16), 4), text16)).otherwise(F.lit(b""))
    rows = derive(spark, sf_dir, _LINES).withColumn("piece", piece)
    before = F.sum(F.octet_length("piece")).over(Window.partitionBy("id").orderBy("line")) - F.octet_length("piece")
    flags = (1 + F.col("line") % 4) * 2 + F.when(named, 1).otherwise(0)
    rows = rows.withColumn("entry", F.concat(_number(F.when(named, before).otherwise(F.col("part") % 65536), 4), _number(flags, 2), _number(F.col("line"), 2)))
    tail = F.unhex(F.lit("00000000C000000000000046"))
    guids = F.concat(_number(0x00062004, 4), tail, _number(F.col("id"), 4), tail)
    streams = rows.groupBy("id").agg(F.expr("listagg(entry) WITHIN GROUP (ORDER BY line)").alias("entries"), F.expr("listagg(piece) WITHIN GROUP (ORDER BY line)").alias("strings")).withColumn("guids", guids)
    return properties.name_map(streams, ["id"]).select("id", "pseudo", _or(-1, "code"), "name", "guid")


_CHANGES = f"""SELECT c_custkey AS item_id, CAST(55 AS INT) AS code, CAST(NULL AS STRING) AS name, '{names.PS_MAPI}' AS guid, 1 AS change, FALSE AS deleted, 'first' AS value FROM customer WHERE c_custkey % 4 = 0
 UNION ALL SELECT c_custkey, 55, NULL, '{names.PS_MAPI}', 2, c_custkey % 8 = 0, 'second' FROM customer WHERE c_custkey % 4 = 0
 UNION ALL SELECT c_custkey, CAST(NULL AS INT), 'Keywords', '{names.PS_PUBLIC_STRINGS}', 3, TRUE, NULL FROM customer WHERE c_custkey % 6 = 0
 UNION ALL SELECT c_custkey, 14929, NULL, '{names.PS_MAPI}', 4, FALSE, c_name FROM customer WHERE c_custkey % 3 = 0
 UNION ALL SELECT c_custkey, 16000, NULL, '{names.PS_MAPI}', 5, c_custkey % 2 = 0, 'more' FROM customer WHERE c_custkey % 3 = 0"""


@register(f"""{_PROPS}, c AS ({_CHANGES}), o AS (SELECT item_id, code, name, guid, min(ord) AS ord, arg_max(value, ord) AS value FROM props GROUP BY ALL), l AS (SELECT item_id, code, name, guid, max(change) AS change, arg_max(deleted, change) AS deleted, arg_max(coalesce(value, ''), change) AS value FROM c GROUP BY ALL),
 b AS (SELECT coalesce(o.item_id, l.item_id) AS item_id, coalesce(o.code, l.code) AS code, coalesce(o.name, l.name) AS name, coalesce(o.guid, l.guid) AS guid, o.ord, l.change, l.deleted, CASE WHEN l.change IS NULL THEN o.value ELSE l.value END AS value
  FROM o FULL JOIN l ON o.item_id = l.item_id AND o.code IS NOT DISTINCT FROM l.code AND o.name IS NOT DISTINCT FROM l.name AND o.guid = l.guid)
 SELECT item_id, coalesce(code, -1) AS code, name, guid, value, CAST(coalesce(ord, max(ord) OVER (PARTITION BY item_id) + row_number() OVER (PARTITION BY item_id, ord IS NULL ORDER BY change)) AS INT) AS ord FROM b WHERE NOT coalesce(deleted, FALSE)""")
def property_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = properties.changed(_props(spark, sf_dir), derive(spark, sf_dir, _CHANGES))
    return out.select("item_id", _or(-1, "code"), "name", "guid", "value", "ord")


@register("SELECT doc_id, CAST(0 AS INT) AS a, CAST(length(lang) AS INT) AS b, CAST(length(lang) + length(source) AS INT) AS c FROM documents")
def heap_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.lit(2).alias("count"), F.lit(0).alias("p0"), F.length("lang").alias("p1"), (F.length("lang") + F.length("source")).alias("p2"))
    block = F.concat(F.encode("lang", "UTF-8"), _le("count", 2), F.unhex(F.lit("0000")), _le("p0", 2), _le("p1", 2), _le("p2", 2))
    found = docs.select("doc_id", binary.heap_table(block, F.length("lang")).alias("r"))
    return found.select("doc_id", F.element_at("r", 2)["from"].alias("a"), F.element_at("r", 2)["to"].alias("b"), F.element_at("r", 3)["to"].alias("c"))


@register("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END AS subject FROM documents")
def subject_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\x01\x05"), "source")).otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", text.subject_without_prefix(raw).alias("subject"))


@register(f"{_NOTE} SELECT item_id, '#<Message message_class=\"IPM.Note\" from=' || coalesce('\"' || sender || '\"', 'nil') || ' subject=\"' || subject || '\">' AS summary FROM f")
def message_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    sender = text.sender_address(F.col("sender_addrtype"), F.col("sender_name"), F.col("sender_email_address"), text.header_joined(F.col("transport"), "From"))
    items = _notes(spark, sf_dir).select("item_id", F.lit("IPM.Note").alias("message_class"), sender.alias("sender"), "subject")
    return messages.summary(items).select("item_id", "summary")


@register("SELECT o_orderkey AS item_id, coalesce(r.n, 0) AS n_recipients, coalesce(a.n, 0) AS n_attachments FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) r ON o_orderkey = r.l_orderkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a ON o_orderkey = a.l_orderkey")
def item_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), "l_returnflag")
    return messages.counts(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id")), lines, lines.where("l_returnflag = 'R'"))


@register(f"SELECT item_id, CASE WHEN item_id % 7 = 0 THEN 'a b c|two' END AS seen FROM ({synth.NOTES})")
def header_multimap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _notes(spark, sf_dir).select("item_id", F.array_join(F.try_element_at(text.header_map(F.col("transport")), F.lit("X-Seen")), "|").alias("seen"))


#: Each nation is a store, whose root is its own parent; its customers are folders below.
_STORES = "SELECT CAST(n_nationkey AS BIGINT) AS file_id, CAST(33 AS BIGINT) AS node_id, 'root' AS kind, n_name AS display_name FROM nation UNION ALL SELECT CAST(c_nationkey AS BIGINT), 100 + c_custkey, 'folder', c_name FROM customer"


@register("SELECT CAST(n_nationkey AS BIGINT) AS file_id, n_name AS name FROM nation")
def store_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.store_name(derive(spark, sf_dir, _STORES), ["file_id"])


@register(f"{_WALK}, {_PLACES} SELECT place, repeat('  ', depth) || '- ' || display_name AS line FROM w JOIN o USING (node_id)")
def tree_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = derive(spark, sf_dir, synth.NODES)
    walked = _folders(spark, sf_dir)
    return tree.tree_text(walked.join(tree.preorder(nodes, nodes.where("node_id = 33"), walked), "node_id"), "display_name")


#: Threads: an order answers the customer's order before it, the first one is a top; of every thirtieth customer the first order
#: answers the last, so that the thread is a circle.
_THREADS = """SELECT o_orderkey AS node_id, CASE WHEN k > 1 THEN before WHEN o_custkey % 30 = 0 THEN latest ELSE o_orderkey END AS parent_id, o_custkey AS ord, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE concat('m', o_orderkey % 97) END AS display_name
 FROM (SELECT o_orderkey, o_custkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, max(o_orderkey) OVER (PARTITION BY o_custkey) AS latest FROM orders) x"""


@register(f"""WITH RECURSIVE nodes AS ({_THREADS}), w(node_id, depth, path, display_name, top, top_ord) AS (SELECT node_id, 0, CAST(NULL AS VARCHAR), display_name, node_id, ord FROM nodes WHERE node_id = parent_id AND ord % 30 <> 0
 UNION ALL SELECT n.node_id, w.depth + 1, CASE WHEN w.depth > 0 THEN nullif(concat_ws('/', w.path, w.display_name), '') END, n.display_name, w.top, w.top_ord FROM w JOIN nodes n ON n.parent_id = w.node_id AND n.node_id <> n.parent_id)
 SELECT n.node_id, coalesce(w.depth, -1) AS depth, CASE WHEN w.node_id IS NOT NULL THEN coalesce(path, '') END AS path, coalesce(p.place, -1) AS place FROM nodes n LEFT JOIN w ON n.node_id = w.node_id
 LEFT JOIN (SELECT node_id, row_number() OVER (ORDER BY top_ord, top, depth) AS place FROM w) p ON n.node_id = p.node_id""")
def thread_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth, path and pre-order of long threads; those on circles have none."""
    nodes = written(derive(spark, sf_dir, _THREADS), "threads")
    tops = nodes.where("node_id = parent_id AND ord % 30 <> 0")
    walked = tree.walk(nodes, tops)
    out = nodes.select("node_id").join(walked, "node_id", "left").join(tree.preorder(nodes, tops, walked), "node_id", "left")
    return out.select("node_id", _or(-1, "depth"), "path", _or(-1, "place"))


@register("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'long' WHEN 1 THEN 'string8' ELSE '0x7777' END AS type_name, CASE p_partkey % 2 WHEN 0 THEN 'subject' ELSE '0x6666' END AS prop_name FROM part")
def table_column_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    columns = table(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 3 == 0, 3).when(k % 3 == 1, 0x1E).otherwise(0x7777).alias("ref_type"), F.when(k % 2 == 0, 0x37).otherwise(0x6666).alias("code"))
    return store.named_columns(columns, names.dictionary(spark).where(F.col("guid") == names.PS_MAPI), names.TYPES).select("id", "type_name", "prop_name")


@register("SELECT l_suppkey FROM lineitem EXCEPT ALL SELECT s_suppkey FROM supplier")
def remaining_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.remaining(table(spark, sf_dir, "lineitem").select("l_suppkey"), table(spark, sf_dir, "supplier").select("s_suppkey"))


@register("""SELECT concat(c_name, '.msg') AS file, 'vcf' AS kind, c_name AS subject, concat('BEGIN:VCARD', chr(10), 'VERSION:3.0', chr(10), 'N:;;;;', chr(10), 'FN:', c_name, chr(10), 'URL:', c_mktsegment, chr(10), 'END:VCARD', chr(10)) AS content FROM customer""")
def message_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers packed as message files, read by joins as property rows and converted to vCards. Customers of one name have a folder
    each, since a path stands for one file."""
    from .plans import convert
    from .sources import compound, message_frames

    def build(name: str, mail: str) -> bytes:
        stream = lambda code, value: compound.Entry(f"__substg1.0_{code:04X}001F", value.encode("utf-16-le"))
        return compound.write(compound.Entry("Root Entry", None, [stream(0x001A, "IPM.Contact"), stream(0x0037, name), stream(0x3A51, mail)]))

    @F.pandas_udf("binary")
    def built(name: pd.Series, mail: pd.Series) -> pd.Series:
        return pd.Series([build(n, m) for n, m in zip(name, mail)])

    path = F.concat(F.monotonically_increasing_id().cast("string"), F.lit("/"), "c_name", F.lit(".msg"))
    files = table(spark, sf_dir, "customer").select(path.alias("path"), built("c_name", "c_mktsegment").alias("content"))
    rows, _ = message_frames.property_rows(written(files, "message-files"))
    return convert.convert(written(rows, "message-rows")).select(F.regexp_replace("file", "^[0-9]+/", "").alias("file"), "kind", "subject", "content")


_ESCAPED = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


@register(f"SELECT doc_id, text, concat('<html>', chr(10), '<body>', replace({_ESCAPED}, chr(10), concat(chr(10), '<br>')), '</body>', chr(10), '</html>', chr(10)) AS html FROM documents")
def rtf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page texts wrapped as RTF, compressed, decompressed and turned back to text."""
    from .functions import rtf

    body = F.regexp_replace(F.regexp_replace("text", r"([\\{}])", r"\\$1"), "\n", r"\\par ")
    docs = table(spark, sf_dir, "documents").select("doc_id", rtf.pack_column(F.concat(F.lit(r"{\rtf1\ansi "), body, F.lit("}"))).alias("packed"))
    docs = docs.select("doc_id", rtf.rtf_column(F.col("packed")).alias("rtf"))
    return docs.select("doc_id", rtf.text_column(F.col("rtf")).alias("text"), rtf.html_column(F.col("rtf")).alias("html"))


@register("SELECT doc_id, sha256(text) AS back FROM documents")
def cipher_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions import cipher

    rule = bytes((i * 167 + 41) % 256 for i in range(256))
    coded = cipher.substitute(F.encode("text", "UTF-8"), rule)
    return table(spark, sf_dir, "documents").select("doc_id", coded.alias("c")).select("doc_id", F.sha2(cipher.substitute(F.col("c"), cipher.inverse(rule)), 256).alias("back"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts of the store with their folder path, type and vCard: names, de-duplication, pivot, tree and text in one plan."""
    records = properties.to_records(_one(spark, sf_dir), _RECORD)
    folders = _folders(spark, sf_dir).select(F.col("node_id").alias("parent_id"), F.concat_ws("/", text.empty_to_null(F.col("path")), "display_name").alias("path"))
    nodes = derive(spark, sf_dir, synth.CUSTOMER_NODES).select((F.col("node_id") - 100000).alias("item_id"), "parent_id")
    out = records.join(nodes, "item_id").join(folders, "parent_id", "left")
    return out.select("item_id", "path", text.mime_type(F.col("message_class")).alias("mime_type"), "subject", messages.vcard({s: F.col(s) for s in _RECORD}).alias("card"))
