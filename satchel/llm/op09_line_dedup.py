"""Line dedup: repeated runs of lines by distributed prefix doubling of line names, in DataFrame functions only.

A text is the sequence of its lines with a word (trimmed of separators), each named by XXH64. Prefix doubling names the run
of 2^j lines at each place by the pair of names of its two halves; lines that occur once end a run (discarding), since no
repeated run holds them. Two runs of n lines count as equal if their first and their last 2^j lines have equal names, for
2^j <= n < 2^(j+1). There is no suffix array: runs are grouped by (n, first name, last name), 128 bits of hash for several
lines and 64 for one, and their texts are not compared.

A run repeats if it has `min_words` words or more and occurs at an earlier place, in order of doc_id and line. A maximal
repeated run is the union of its shortest sub-runs of min_words words from each line on and up to each line, so only these
are looked up, and all lines that a later copy covers are deleted, with the blank lines between them. Runs are judged on
the input; the first copy stays.

Null texts stay null and have no lines, empty ones stay empty and have one. Rows with equal doc_id and text are one document: they get the same result. Rows
with equal doc_id and other texts are ordered by the texts' hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_path, materialize

MIN_WORDS = 20
_EDGE = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
_WORD = r"[^\x20\x09-\x0D]+"


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, h, ord (among lines with a word), line (place in the text), id and words of each such line."""
    listed = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("line"), F.regexp_replace(x, _EDGE, "").alias("s"))), lambda x: x["s"] != "")
    rows = docs.where("text is not null").select("doc_id", "h", F.posexplode(listed).alias("ord", "x"))
    return rows.select("doc_id", "h", "ord", "x.line", F.xxhash64("x.s").alias("id"), F.regexp_count("x.s", F.lit(_WORD)).alias("words"))


def _run_keys(lines: DataFrame, min_words: int) -> DataFrame:
    """The shortest runs of min_words words from each line on and up to each line: doc_id, h, ord, first, last, n, a, b.
    lines: those that occur twice or more; (n, a, b) names the run's content."""
    by_doc = Window.partitionBy("doc_id", "h").orderBy("ord")
    # repeated rows are one document: each place counts once
    lines = lines.withColumn("before", F.lag("ord").over(by_doc)).where("before is null or before <> ord").drop("before")
    # lines that follow one another form a stretch: ord - row_number is the same
    lines = lines.withColumn("stretch", F.col("ord") - F.row_number().over(by_doc))
    own = Window.partitionBy("doc_id", "h", "stretch").orderBy("ord")
    size = 1
    lines = lines.withColumnRenamed("id", "r1")
    while 2 * size <= min_words:  # a run of min_words words has at most so many lines
        half = F.lead(f"r{size}", size).over(own)
        lines = lines.withColumn(f"r{2 * size}", F.when(half.isNotNull(), F.xxhash64(f"r{size}", half)))
        size *= 2
    sizes = [2**k for k in range(size.bit_length())]
    item = F.struct("ord", "line", "words", *[f"r{k}" for k in sizes])
    lines = lines.select("doc_id", "h", "stretch", "ord", item.alias("x"))

    def shortest(frame, turned: bool):
        """The fewest lines of the frame, nearest first, that reach min_words; in reading order, null if none does."""
        near = F.reverse(frame) if turned else frame
        step = F.aggregate(
            near, F.struct(F.lit(0).cast("long").alias("w"), F.lit(0).alias("n")),
            lambda a, y: F.when(a["w"] >= min_words, a).otherwise(F.struct((a["w"] + y["words"]).alias("w"), (a["n"] + 1).alias("n"))),
        )
        part = F.slice(near, 1, step["n"])
        return F.when(step["w"] >= min_words, F.reverse(part) if turned else part)

    ahead = F.collect_list("x").over(own.rowsBetween(0, min_words - 1))
    behind = F.collect_list("x").over(own.rowsBetween(-(min_words - 1), 0))
    both = lines.select("doc_id", "h", ahead.alias("ahead"), behind.alias("behind"))
    both = both.select("doc_id", "h", F.explode(F.array(shortest(F.col("ahead"), False), shortest(F.col("behind"), True))).alias("r")).where("r is not null")
    n = F.size("r")
    first, second = None, None
    for k in reversed(sizes):
        x, y = F.element_at("r", 1)[f"r{k}"], F.try_element_at("r", n - k + 1)[f"r{k}"]
        first = F.when(n >= k, x) if first is None else first.when(n >= k, x)
        second = F.when(n >= k, y) if second is None else second.when(n >= k, y)
    head, tail = F.element_at("r", 1), F.element_at("r", -1)
    return both.select("doc_id", "h", head["ord"].alias("ord"), head["line"].alias("first"), tail["line"].alias("last"), n.alias("n"), first.alias("a"), second.alias("b")).distinct()


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, h and runs (first, last), ascending and apart: the lines that later copies cover. docs: doc_id, text, h."""
    spark = docs.sparkSession
    lines, lines_path = materialize(_lines(docs), "lines")
    # a table of its own, so that the join reads two plain exchanges, of which adaptive execution splits that of a common line
    twice, twice_path = materialize(lines.groupBy("id").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("id"), "repeated-lines")
    runs, _ = materialize(_run_keys(lines.join(twice, "id", "left_semi"), min_words), "runs")
    drop_path(spark, lines_path, twice_path)
    place = F.struct("doc_id", "h", "ord")
    copied = runs.groupBy("n", "a", "b").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("earliest")).where("copies > 1").select("n", "a", "b", "earliest")
    earliest, _ = materialize(copied, "earliest")
    later = runs.join(earliest, ["n", "a", "b"]).where(place != F.col("earliest")).select("doc_id", "h", "first", "last").distinct()
    by_doc = Window.partitionBy("doc_id", "h").orderBy("first", "last")
    reach = F.max("last").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    later = later.withColumn("new", F.when(reach.isNull() | (F.col("first") > reach + 1), 1).otherwise(0))
    later = later.withColumn("group", F.sum("new").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    spans = later.groupBy("doc_id", "h", "group").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return spans.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def deduplicate_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col cut, and n_lines, n_removed (lines) and runs_removed; columns of these names are replaced."""
    names = ["n_lines", "n_removed", "runs_removed"]
    docs = docs.drop(*names)
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    runs = repeated_runs(plain, min_words).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), F.col("runs").alias("__runs"))
    keyed = docs.withColumn("__text_hash", F.xxhash64(text_col))
    joined = keyed.join(runs, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__h")), "left")
    lines = F.split(text_col, "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.exists("__runs", lambda r: (i >= r["first"]) & (i <= r["last"])))
    removed = F.aggregate("__runs", F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"] + 1)
    out = joined.withColumns({
        "n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long"),
        "n_removed": F.coalesce(removed, F.lit(0).cast("long")),
        "runs_removed": F.greatest(F.coalesce(F.size("__runs").cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long")),
        text_col: F.when(F.col("__runs").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")),
    })
    return out.select(*docs.columns, *names)


ORACLE = f"""
WITH RECURSIVE l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
l AS (SELECT doc_id, line, s, len(list_filter(regexp_split_to_array(s, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS words FROM (SELECT doc_id, line, regexp_replace(s, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS s FROM l0) WHERE s <> ''),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS ord FROM l),
c AS (SELECT doc_id, list(s ORDER BY ord) AS ss, list(line ORDER BY ord) AS ls, list(words ORDER BY ord) AS ns FROM o GROUP BY doc_id),
t AS (SELECT doc_id, a, a + k - 1 AS z, ls[a] AS first, ls[a + k - 1] AS last, array_to_string(ss[a:a + k - 1], chr(10)) AS body, list_sum(ns[a:a + k - 1]) AS w, ns[a] AS head, ns[a + k - 1] AS tail
  FROM (SELECT *, unnest(range(1, least({MIN_WORDS}, len(ss) - a + 1) + 1)) AS k FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS a FROM c))),
m AS (SELECT * FROM t WHERE w >= {MIN_WORDS} AND (w - tail < {MIN_WORDS} OR w - head < {MIN_WORDS})),
e AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, a) AS copy FROM m),
x AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS line FROM e WHERE copy > 1),
k AS (SELECT l0.doc_id, string_agg(l0.s, chr(10) ORDER BY l0.line) FILTER (x.line IS NULL) AS kept, count(x.line) AS n_removed, count(*) AS n_lines FROM l0 LEFT JOIN x ON l0.doc_id = x.doc_id AND l0.line = x.line GROUP BY l0.doc_id)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""
