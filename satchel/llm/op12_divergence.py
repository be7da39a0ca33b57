"""Source divergence audit: how far apart the term frequencies of a language's sources are, and which terms tell a source.

1. Each task counts the terms of its documents into byte tries, one for each language and first three bytes, with a counter for
   each source at the leaves, and gives them as rows (byte_trie). A task's tries are given out early when they have many leaves.
2. Ranges of a prefix with too many counters are cut at a longer prefix, again and again; a range of one term that as many
   tasks have is merged in groups of tasks first. Then all rows of a range are merged: what is in memory is bounded by
   RANGE_LEAVES, whatever the term frequencies are.
3. A traversal of a merged trie gives the kept terms in order of UTF-8, packed as one row a range. The sizes of vocabularies and
   the sums of counts of each group follow from these rows.
4. A second traversal compares the sources of a language on each range: sums for pairs, and the ten best candidates of each
   source, whose ties are in order already. Sums are added and candidates ranked in Spark.

All arithmetic is in whole numbers: p = 1 + floor(10^9 (count + 2) / (N + 2 V)) by long division in base 1000, which is exact for
sums of counts below 9 * 10^15. Null text, lang and source read as empty; a document of an unknown id counts as any other, and
so does each of several equal rows. A group without terms has count 0 everywhere; a language without kept terms has pairs of
value 0. An empty table gives no rows. Only lang, source and text are read, so other columns may have any name.

The sources of one language are held as a list by the tasks of step 4 (a sum for each pair of them, as in the result).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_trie import columns, keys_of, load
from .common import drop_path, materialize, slices, texts_of

#: Bytes that stand in terms become themselves, A-Z their lower case, all others blanks. Bytes of other characters than ASCII are
#: 0x80 and above, so terms of a text's UTF-8 bytes are those of its characters.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_BREAK = re.compile(rb"[^A-Za-z\x80-\xff]")
#: Texts of more bytes are counted piece by piece, cut between terms.
PIECE_BYTES = 4 << 20
#: Counters that a task holds before it gives its tries out, and that one merged range may have; groups of a task; the length of
#: the prefixes by which ranges are cut at first.
TASK_LEAVES, RANGE_LEAVES, MOST_GROUPS, FIRST_DEPTH = 1_000_000, 500_000, 1 << 20, 3
MIN_DOCS, TOP = 10, 10
#: A trie as a row: its nodes in pre-order, and of each key its documents and the counters of as many sources as sizes says.
_ROW = "lang string, prefix binary, task long, n_leaves long, longest int, sources array<string>, labels array<binary>, kids array<int>, ends array<boolean>, docs array<long>, sizes array<int>, src array<int>, n array<long>"
_COLUMNS = [c.split(" ")[0] for c in _ROW.split(", ")]
_KEPT = "lang string, terms array<string>, ends array<int>, sources array<string>, src array<int>, n array<long>, totals array<long>"


def _pieces(raw: bytes) -> Iterator[bytes]:
    at = 0
    while len(raw) - at > PIECE_BYTES:
        found = _BREAK.search(raw, at + PIECE_BYTES)
        if found is None:
            break
        yield raw[at : found.start()]
        at = found.start()
    yield raw[at:]


def count_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(row, term number, occurrences) of the distinct terms of each text, and the terms."""
    flat, lengths, long_rows = [], [], {}
    for i, raw in enumerate(texts.cast(pa.binary()).to_pylist()):
        if len(raw) > PIECE_BYTES:
            counted = long_rows[i] = Counter()
            for piece in _pieces(raw):
                counted.update(piece.translate(_TABLE).split())
            words = list(counted)
        else:
            words = raw.translate(_TABLE).split()
        flat += words
        lengths.append(len(words))
    coded = pa.array(flat, pa.large_binary()).dictionary_encode()
    terms, size = coded.dictionary.to_pylist(), max(len(coded.dictionary), 1)
    pairs = np.repeat(np.arange(len(lengths)) * size, lengths) + coded.indices.to_numpy(zero_copy_only=False)
    pairs.sort()
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(pairs)))
    pairs = pairs[first]
    row, code = pairs // size, pairs % size
    for i, counted in long_rows.items():  # their terms stand here once each
        own = np.flatnonzero(row == i)
        times[own] = [counted[terms[c]] for c in code[own].tolist()]
    return row, code, times, terms


def _rows(lang: str, keys: list[bytes], sizes: np.ndarray, src: np.ndarray, n: np.ndarray, docs: np.ndarray, names: list[str], depth: int) -> Iterator[dict]:
    """A trie for each prefix of `depth` bytes. keys: sorted; src and n: the counters of one key after another."""
    task = TaskContext.get().partitionId() if TaskContext.get() else 0
    edges = np.concatenate([[0], np.cumsum(sizes)])
    a = 0
    while a < len(keys):
        prefix, b = keys[a][:depth], a + 1
        while b < len(keys) and keys[b].startswith(prefix) and len(prefix) == depth:
            b += 1
        labels, kids, ends = columns(load(keys[a:b]))
        own = slice(edges[a], edges[b])
        used, place = np.unique(src[own], return_inverse=True)
        yield {
            "lang": lang, "prefix": prefix, "task": task, "n_leaves": len(place), "longest": max(map(len, keys[a:b])), "sources": [names[k] for k in used.tolist()],
            "labels": labels, "kids": kids, "ends": ends, "docs": docs[a:b], "sizes": sizes[a:b], "src": place, "n": n[own],
        }
        a = b


def _batches(rows: Iterator[dict], schema: str) -> Iterator[pa.RecordBatch]:
    waiting, leaves = [], 0
    for row in rows:
        waiting.append(row)
        leaves += row["n_leaves"]
        if leaves > 100_000 or len(waiting) >= 5000:
            yield _batch(waiting, schema)
            waiting, leaves = [], 0
    if waiting:
        yield _batch(waiting, schema)


_ARROW = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}


def _schema(text: str) -> pa.Schema:
    fields = []
    for part in text.split(", "):
        name, kind = part.split(" ")
        inner = kind.removeprefix("array<").removesuffix(">")
        fields.append(pa.field(name, pa.list_(_ARROW[inner]) if kind != inner else _ARROW[kind]))
    return pa.schema(fields)


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    fields = _schema(schema)
    return pa.RecordBatch.from_arrays([pa.array([row[f.name] for row in rows], f.type) for f in fields], schema=fields)


class _Counts:
    """The counts of a task: numbers of groups and terms, and the sums of what was seen of both."""

    def __init__(self):
        self.groups, self.terms, self.waiting, self.n_waiting = {}, {}, [], 0
        self.key, self.times, self.docs = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, groups: list[tuple[str, str]], texts: pa.Array) -> None:
        row, code, times, terms = count_terms(texts)
        group = np.fromiter((self.groups.setdefault(g, len(self.groups)) for g in groups), np.int64, len(groups))
        number = np.fromiter((self.terms.setdefault(t, len(self.terms)) for t in terms), np.int64, len(terms))
        if len(row):
            self.waiting.append((number[code] << 24 | group[row], times, np.ones(len(row), np.int64)))
            self.n_waiting += len(row)
        if self.n_waiting > TASK_LEAVES:
            self.sum()

    def sum(self) -> None:
        key, times, docs = (np.concatenate(x) for x in zip((self.key, self.times, self.docs), *self.waiting))
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.key = key[first]
        self.times, self.docs = (np.add.reduceat(x[order], first) if len(first) else x for x in (times, docs))
        self.waiting, self.n_waiting = [], 0

    def tries(self) -> Iterator[dict]:
        """Rows of the tries of all that was counted; the counts are empty afterwards."""
        self.sum()
        groups, terms = list(self.groups), list(self.terms)
        langs: dict[str, int] = {}
        names: dict[str, int] = {}
        lang = np.array([langs.setdefault(g[0], len(langs)) for g in groups], np.int64)
        source = np.array([names.setdefault(g[1], len(names)) for g in groups], np.int64)
        rank = np.empty(len(terms), np.int64)
        order = pc.sort_indices(pa.array(terms, pa.large_binary())).to_numpy() if terms else np.zeros(0, np.int64)
        rank[order] = np.arange(len(terms))
        group, place = self.key & 0xFFFFFF, rank[self.key >> 24]
        for name, x in langs.items():
            own = np.flatnonzero(lang[group] == x)
            own = own[np.argsort(place[own], kind="stable")]
            first = np.flatnonzero(np.concatenate([[True], place[own][1:] != place[own][:-1]])) if len(own) else np.zeros(0, np.int64)
            if len(own):
                keys = [terms[k] for k in order[place[own][first]].tolist()]
                sizes = np.diff(np.append(first, len(own)))
                yield from _rows(name, keys, sizes, source[group[own]], self.times[own], np.add.reduceat(self.docs[own], first), list(names), FIRST_DEPTH)
        self.__init__()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = _Counts()
    for whole in batches:
        for batch in slices(whole, "text"):
            counts.add(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), texts_of(batch, "text"))
            if len(counts.key) > TASK_LEAVES or len(counts.groups) > MOST_GROUPS:
                yield from _batches(counts.tries(), _ROW)
    yield from _batches(counts.tries(), _ROW)


class _Merged:
    """The keys of all tries of a table, in order, with the sums of their counters: keys, docs, and sizes, src, n of counters; names
    of sources."""

    def __init__(self, table: pa.Table | pa.RecordBatch):
        flat = {}
        for name in ("labels", "kids", "ends", "docs", "sizes", "src", "n", "sources"):
            column = table.column(name)
            flat[name] = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
        number: dict[str, int] = {}
        of_row = np.array([number.setdefault(s, len(number)) for s in flat["sources"].to_pylist()], np.int64)
        lengths = lambda name: pc.list_value_length(table.column(name)).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else pc.list_value_length(table.column(name)).to_numpy()
        shift = np.repeat(np.concatenate([[0], np.cumsum(lengths("sources"))])[:-1], lengths("src"))
        src = of_row[shift + flat["src"].to_numpy()] if len(shift) else shift
        found = keys_of(flat["labels"].to_pylist(), flat["kids"].to_pylist(), flat["ends"].to_pylist())
        self.keys = sorted(set(found))
        place = {k: i for i, k in enumerate(self.keys)}
        at = np.fromiter((place[k] for k in found), np.int64, len(found))
        self.docs = np.zeros(len(self.keys), np.int64)
        np.add.at(self.docs, at, flat["docs"].to_numpy())
        self.names = list(number)
        size = max(len(self.names), 1)
        pairs, own = np.unique(np.repeat(at, flat["sizes"].to_numpy()) * size + src, return_inverse=True)
        self.n = np.zeros(len(pairs), np.int64)
        np.add.at(self.n, own, flat["n"].to_numpy())
        self.src, self.sizes = pairs % size, np.bincount(pairs // size, minlength=len(self.keys))


def _recut(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                m = _Merged(row)
                yield from _batches(_rows(row.column(0)[0].as_py(), m.keys, m.sizes, m.src, m.n, m.docs, m.names, depth), _ROW)

    return run


def _merge(table: pa.Table) -> pa.Table:
    """All tries of a table, which are of one range, as one."""
    m = _Merged(table)
    depth = max(len(table.column("prefix")[0].as_py()), 1)
    return pa.Table.from_batches(list(_batches(_rows(table.column("lang")[0].as_py(), m.keys, m.sizes, m.src, m.n, m.docs, m.names, depth), _ROW)))


def _keep(min_docs: int):
    def run(table: pa.Table) -> pa.Table:
        m = _Merged(table)
        kept = np.flatnonzero(m.docs >= min_docs)
        rows = []
        if len(kept):
            own = np.repeat(m.docs >= min_docs, m.sizes)
            src, n = m.src[own], m.n[own]
            totals = np.zeros(len(m.names), np.int64)
            np.add.at(totals, src, n)
            rows.append({"lang": table.column("lang")[0].as_py(), "terms": [m.keys[i].decode() for i in kept.tolist()], "ends": np.cumsum(m.sizes[kept]), "sources": m.names, "src": src, "n": n, "totals": totals})
        return pa.Table.from_batches([_batch(rows, _KEPT)], _schema(_KEPT))

    return run


def merged_terms(docs: DataFrame, min_docs: int = MIN_DOCS, range_leaves: int = RANGE_LEAVES) -> tuple[DataFrame, str]:
    """The kept terms of each language, packed by range: lang, terms (in order of UTF-8), ends, sources, src, n, totals; and the
    folder of that table. docs: lang, source, text without nulls in the first two."""
    spark = docs.sparkSession
    pending, path = materialize(docs.select("lang", "source", "text").mapInArrow(_count, _ROW), "tries")
    done, paths, depth = [], [path], FIRST_DEPTH
    while True:
        sizes = pending.groupBy("lang", "prefix").agg(F.sum("n_leaves").alias("leaves"), F.max("longest").alias("longest"), F.count(F.lit(1)).alias("rows"))
        hot, hot_path = materialize(sizes.where(F.col("leaves") > range_leaves), "hot-ranges")
        paths.append(hot_path)
        if not hot.limit(1).count():
            done.append(pending)
            break
        key = ["lang", "prefix"]
        done.append(pending.join(hot.select(*key), key, "left_anti"))
        # a range of one term: merged in as many groups of tasks as it is too large; it can't be cut
        single = hot.where(F.col("longest") <= F.length("prefix"))
        parts = F.pmod(F.col("task"), F.ceil(F.col("leaves") / range_leaves))
        one = pending.join(single.select(*key, "leaves"), key).withColumn("_part", parts).select(*_COLUMNS, "_part")
        done.append(one.groupBy("lang", "prefix", "_part").applyInArrow(lambda t: _merge(t.drop_columns(["_part"])), _ROW))
        depth += 2
        many = pending.join(hot.where(F.col("longest") > F.length("prefix")).select(*key), key, "left_semi")
        pending, path = materialize(many.select(*_COLUMNS).mapInArrow(_recut(depth), _ROW), "tries")
        paths.append(path)
    ranges = done[0]
    for more in done[1:]:
        ranges = ranges.unionByName(more)
    kept, path = materialize(ranges.groupBy("lang", "prefix").applyInArrow(_keep(min_docs), _KEPT), "kept-terms")
    drop_path(spark, *paths)
    return kept, path


def scaled(count: np.ndarray, below: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / below), exactly; count + 2 is at most below, which is under 9 * 10^15."""
    rest, out = count + 2, np.zeros(np.broadcast(count, below).shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // below
        rest = rest % below
    return out + 1


_FOUND = "lang string, source string, part string, item string, value long"


def _compare(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[list[str], np.ndarray]] = {}
        cells = 0

        def pairs() -> Iterator[pa.RecordBatch]:
            for lang, (names, total) in sums.items():
                for a, name in enumerate(names):
                    yield _batch([{"lang": lang, "source": name, "part": "pair", "item": names[b], "value": int(total[min(a, b), max(a, b)])} for b in range(len(names)) if b != a], _FOUND)
            sums.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                names, v = row["all_sources"], row["v"]
                at, size = {s: k for k, s in enumerate(names)}, len(names)
                below = np.array(row["all_totals"], np.int64) + 2 * v
                whole = sum(row["all_totals"]) + 2 * v
                if row["lang"] not in sums:
                    sums[row["lang"]] = (names, np.zeros((size, size), np.int64))
                    cells += size * size
                total = sums[row["lang"]][1]
                slot = np.array([at[s] for s in row["sources"]], np.int64)
                src, n, ends = slot[np.array(row["src"], np.int64)], np.array(row["n"], np.int64), np.array(row["ends"], np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                best: list[list[tuple[int, int]]] = [[] for _ in names]
                step = max(1, 1_000_000 // size)
                for first in range(0, len(ends), step):
                    last = min(first + step, len(ends))
                    count = np.zeros((last - first, size), np.int64)
                    a, b = starts[first], ends[last - 1]
                    count[np.repeat(np.arange(last - first), (ends - starts)[first:last]), src[a:b]] = n[a:b]
                    p = scaled(count, below)
                    for k in range(size - 1):
                        d = p[:, k + 1 :] - p[:, k : k + 1]
                        total[k, k + 1 :] += (d * d // (p[:, k + 1 :] + p[:, k : k + 1])).sum(0)
                    q = scaled(count.sum(1), np.int64(whole))
                    for k in range(size):
                        own = np.flatnonzero((count[:, k] > 0) & (p[:, k] > q))
                        d = p[own, k] - q[own]
                        value = d * d // (p[own, k] + q[own])
                        order = np.argsort(-value, kind="stable")[:top]
                        best[k] += [(-int(value[x]), first + int(own[x])) for x in order]
                found = [{"lang": row["lang"], "source": names[k], "part": "term", "item": row["terms"][x], "value": -f} for k in range(size) for f, x in sorted(best[k])[:top]]
                if found:
                    yield _batch(found, _FOUND)
                if cells > 4_000_000:
                    yield from pairs()
                    cells = 0
        yield from pairs()

    return run


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, top: int = TOP, range_leaves: int = RANGE_LEAVES) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` gives the other sources of the language by divergence, part `term` the
    terms that are commoner in the source than in its language, at most `top` of them."""
    empty = F.lit("")
    read = docs.select(F.coalesce(F.col(lang_col), empty).alias("lang"), F.coalesce(F.col(source_col), empty).alias("source"), F.coalesce(F.col(text_col), empty).alias("text"))
    kept, _ = merged_terms(read, min_docs, range_leaves)
    groups, _ = materialize(read.select("lang", "source").distinct(), "groups")
    own = kept.select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.totals").alias("total"))
    sizes = kept.groupBy("lang").agg(F.sum(F.size("terms")).alias("v"))
    listed = groups.join(own, ["lang", "source"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total")))).alias("x"))
    listed = listed.join(sizes, "lang").select("lang", "v", F.col("x.source").alias("all_sources"), F.col("x.total").alias("all_totals"))
    found = kept.join(listed, "lang").mapInArrow(_compare(top), _FOUND)
    found, _ = materialize(found, "divergence")
    other = groups.select("lang", F.col("source").alias("item"))
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pair = groups.join(other, "lang").where("source <> item").join(sums, ["lang", "source", "item"], "left")
    pair = pair.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    ranked = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    term = found.where("part = 'term'").withColumn("rank", ranked).where(F.col("rank") <= top)
    return pair.withColumn("rank", ranked).unionByName(term).select("lang", "source", "part", "item", "value", "rank")


ORACLE = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS c FROM t GROUP BY lang, term HAVING count(*) >= 10),
v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
own AS (SELECT lang, source, term, CAST(sum(n) AS HUGEINT) AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
gn AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN own USING (lang, source) GROUP BY ALL),
p AS (SELECT gn.lang, gn.source, kept.term, coalesce(own.c, 0) AS c, 1 + (1000000000 * (coalesce(own.c, 0) + 2))::HUGEINT // (gn.n + 2 * v.v)::HUGEINT AS p FROM gn JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN own ON own.lang = gn.lang AND own.source = gn.source AND own.term = kept.term),
q AS (SELECT lang, term, 1 + (1000000000 * (c + 2))::HUGEINT // (n + 2 * v)::HUGEINT AS p FROM kept JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
term AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST((p.p - q.p) * (p.p - q.p) // (p.p + q.p) AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE p.c > 0 AND p.p > q.p)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)) WHERE part = 'pair' OR rank <= 10"""
