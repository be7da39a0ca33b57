"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

A window is `width` consecutive words of an item (an item of fewer words is one window). For a window to occur in a document
all its words must, so with the words ordered by their rarity in the documents a prefix of one word, the rarest, is
necessary: document words are joined to the windows on it. The word's place must leave room for the whole window on both
sides (positional bounds), the document must have as many words (length bound), and survivors are verified word by word.

Candidates of a document are checked a stretch of its words at a time, each window once, whatever the number of items that
have it; items are joined to the windows that did occur.

Null and empty texts have no words: no hits. Rows with equal doc_id and text get equal results, one each; equal item_ids count
once. A null item_id is no item: its windows hit words but are not counted or listed. An empty benchmark leaves every document
clean. Other columns of either table are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialize

#: Everything but digits, a-z and characters beyond ASCII, after A-Z were lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A side of at most so many short rows is broadcast; beyond it the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: Words of a document whose candidates are held together.
STRETCH = 2_000


def words(col):
    return F.filter(F.split(lower_ascii(F.coalesce(col, F.lit(""))), GAP), lambda w: w != "")


def _small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if its rows and the bytes of its strings are within the bounds."""
    size = F.lit(0)
    for name, kind in df.dtypes:
        size = size + F.coalesce(F.octet_length(name), F.lit(0)) if kind == "string" else size + 8
    rows, held = df.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and held <= BROADCAST_BYTES else df


def windows(items: DataFrame, width: int) -> DataFrame:
    """item_id, start, w (words of the window) of each distinct window of (item_id, text)."""
    listed = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("ws") - width, F.lit(0)))
    return listed.select("item_id", "ws", F.explode(starts).alias("start")).select("item_id", F.slice("ws", F.col("start") + 1, F.lit(width)).alias("w")).distinct()


def _anchored(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Windows with their rarest word: word, offset, size, window (joined by blanks), item_id."""
    vocabulary, _ = materialize(found.select(F.explode("w").alias("word")).distinct(), "vocabulary")
    counted = docs.select(F.explode(words(F.col("text"))).alias("word")).join(_small(vocabulary), "word", "left_semi").groupBy("word").count()
    counted, _ = materialize(vocabulary.join(counted, "word", "left").select("word", F.coalesce("count", F.lit(0)).alias("seen")), "rarity")
    placed = found.select(F.xxhash64("item_id", "w").alias("k"), "item_id", F.array_join("w", " ").alias("window"), F.size("w").alias("size"), F.posexplode("w").alias("offset", "word"))
    ranked = placed.join(_small(counted), "word").groupBy("k", "item_id", "window", "size").agg(F.min(F.struct("seen", "word", "offset")).alias("m"))
    return ranked.where("m.seen > 0").select("m.word", "m.offset", "size", "window", "item_id")


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and spans (start, end of hit runs' windows) of each row."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    source = source.withColumn("h", F.xxhash64("text"))
    anchors, _ = materialize(_anchored(windows(items.select("item_id", "text"), width), source), "anchors")
    ws = words(F.col("text"))
    placed = source.select("doc_id", "h", ws.alias("ws")).select("doc_id", "h", F.size("ws").alias("n"), F.posexplode("ws").alias("at", "word"))
    begin = F.col("at") - F.col("offset")
    near = placed.join(_small(anchors.select("word", "offset", "size", "window").distinct()), "word").where((begin >= 0) & (begin + F.col("size") <= F.col("n")))
    near = near.select(F.col("doc_id").alias("near_id"), F.col("h").alias("near_h"), F.struct(begin.alias("begin"), "size", "window").alias("x"))
    near = near.groupBy("near_id", "near_h", F.floor(F.col("x.begin") / STRETCH).alias("stretch")).agg(F.collect_set("x").alias("near"))
    same = F.col("doc_id").eqNullSafe(F.col("near_id")) & (F.col("h") == F.col("near_h"))
    rows = source.join(near, same, "left").select("doc_id", "h", "stretch", ws.alias("ws"), "near")
    hit = F.filter("near", lambda c: F.array_join(F.slice(F.col("ws"), c["begin"] + 1, c["size"]), " ") == c["window"])
    # written with n_words: else the optimiser moves the splitting of texts into the check of each candidate
    rows, _ = materialize(rows.select("doc_id", "h", "stretch", F.size("ws").cast("long").alias("n_words"), hit.alias("hits")), "stretches")
    whole = rows.groupBy("doc_id", "h", "stretch").agg(F.count(F.lit(1)).alias("copies"), F.max("n_words").alias("n_words"))
    whole = whole.groupBy("doc_id", "h").agg(F.max("copies").cast("int").alias("copies"), F.max("n_words").alias("n_words"))
    key = [F.col("doc_id").alias("_id"), F.col("h").alias("_h")]
    hits, _ = materialize(rows.where(F.size("hits") > 0).select(*key, F.explode("hits").alias("x")).select("_id", "_h", "x.*").distinct(), "hits")
    place = F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("size") - 1)).alias("at")
    counted = hits.select("_id", "_h", place).distinct().groupBy("_id", "_h").agg(F.count(F.lit(1)).alias("n_hit"))
    named = hits.select("_id", "_h", "window").distinct().join(_small(anchors.where("item_id is not null").select("window", "item_id").distinct()), "window")
    named = named.groupBy("_id", "_h").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    spans = hits.groupBy("_id", "_h").agg(F.array_sort(F.collect_set(F.struct("begin", (F.col("begin") + F.col("size")).alias("end")))).alias("spans"))
    out = whole
    for part in (counted, named, spans):
        out = out.join(part, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left").drop("_id", "_h")
    out = out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"), "spans", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items", "spans")


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows in which a window of an item occurs."""
    found = contamination(docs.withColumn("__key", F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"))), items, width, "__key", text_col)
    bad = found.where("contaminated").select(F.col("doc_id").alias("__key")).distinct()
    keyed = docs.withColumn("__key", F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h")))
    return keyed.join(bad.withColumnRenamed("__key", "__bad"), F.col("__key").eqNullSafe(F.col("__bad")), "left_anti").drop("__key")


ORACLE = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, least(len(ws), 10) AS size, array_to_string(ws[s:s + least(len(ws), 10) - 1], ' ') AS win FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS s FROM b WHERE len(ws) > 0)),
z AS (SELECT DISTINCT size FROM w),
p AS (SELECT doc_id, size, s, array_to_string(ws[s:s + size - 1], ' ') AS win FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS s FROM d, z WHERE len(ws) >= size)),
h AS (SELECT p.doc_id, p.s, p.size, w.item_id FROM p JOIN w ON p.size = w.size AND p.win = w.win),
k AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS place FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(k.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(k.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k ON d.doc_id = k.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""
