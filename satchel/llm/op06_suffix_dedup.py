"""Suffix-array dedup of texts as bytes: every byte covered by a `length`-byte string that also starts elsewhere goes.

Distribution. Every `length`-byte window has one anchor: of its GRAM-byte substrings the one of the smallest hash, leftmost
if tied. It depends on the window's bytes alone, so equal windows have equal anchors at equal places, and meet in the shard of
the anchor's hash. Neighbouring windows with one anchor are a run; a run is described by the anchor's hash and a hash of all
its bytes (together 128 bits). Anchors that stand at one place only are done. Of every other run the index gets the bytes: of
one place, and of a second where the description occurs again. What the index finds in a run holds for all its places, so
groups of copies don't travel as text.

Index. Each shard holds a logarithmic family of suffix arrays (here: windows in byte order). A new batch of texts gets its
suffix array, is merge-scanned against the existing levels for matches of `length` bytes, and becomes a level; levels of the
same rank are merged into one of the next rank. A family ends at a shard's border once it is large. Anchors
with very many different runs are cut into shards by the windows' distance from the anchor, and beyond that by their bytes,
so memory is bounded by about FAMILY_WINDOWS windows.

Null and empty texts have no bytes. Matches never cross documents; a string's other start may lie in the same document and
overlap. Rows with equal doc_id and text are copies of each other; they get the same result. A row is named by two 64-bit hashes of
its id and text. A null doc_id is an id like any other. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_path, materialize, slices

LENGTH = 200
GRAM = 64
#: Windows in one family of levels before it ends at the next anchor.
FAMILY_WINDOWS = 150_000
BATCH_WINDOWS = 20_000
#: Texts are read in segments of so many starts.
SEGMENT = 1 << 20
_BASE, _OTHER = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)  # a fixed value for each byte
_LOW = np.uint64((1 << 32) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64."""

    def __init__(self, base: int):
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 1 << 64), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.uint64((1 << 64) - 1))
    padded[: len(x)] = x
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


class Runs:
    """Runs of windows with one anchor in a stretch of bytes."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram, self.p, self.q = length, gram, _Powers(_BASE), _Powers(_OTHER)

    def find(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """(first start, last start, anchor, anchor's hash, run's hash) of the runs of the ascending window starts given."""
        n, k = len(data), self.gram
        value = _VALUES[data]
        up, down = self.p.upto(n + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(value * up[:n], dtype=np.uint64)])
        grams = _mix((sums[k:] - sums[:-k]) * down[: n - k + 1])
        key = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
        anchor = (_sliding_min(key, self.length - k + 1)[starts] & _LOW).astype(np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
        at = np.flatnonzero(new)
        first, last, anchor = starts[at], starts[np.append(at[1:], len(starts)) - 1], anchor[at]
        up, down = self.q.upto(n + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(value * up[:n], dtype=np.uint64)])
        whole = (sums[last + self.length] - sums[first]) * down[first]
        whole = _mix(whole + _mix(((last - first) * 4096 + anchor - first).astype(np.uint64)))
        return first, last, anchor, grams[anchor], whole


def _runs(docs: DataFrame, length: int) -> DataFrame:
    """Runs of all texts: h, g, more (last - first), ahead (anchor - first), keys, tails (the second hash of the key) and firsts
    of the places in this batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Runs(length)
        names = ["h", "g", "more", "ahead", "keys", "tails", "firsts"]
        for whole in batches:
            for batch in slices(whole, "text", SEGMENT):
                text, keys, tails = batch.column("text"), *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "tail"))
                offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
                data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
                offsets = offsets - offsets[0]
                for a in range(0, max(len(data), 1), SEGMENT):
                    part = data[a : a + SEGMENT + length - 1]
                    begin, count = offsets[:-1], np.maximum(np.diff(offsets) - length + 1, 0)
                    low, high = np.maximum(begin, a), np.minimum(begin + count, a + SEGMENT)
                    size = np.maximum(high - low, 0)
                    if not size.sum():
                        continue
                    starts = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(int(size.sum())) - a
                    first, last, anchor, h, g = finder.find(part, starts)
                    doc = np.searchsorted(offsets, first + a, side="right") - 1
                    order = np.lexsort((g, h))
                    new = np.ones(len(order), bool)
                    new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
                    at = np.flatnonzero(new)
                    cuts = pa.array(np.append(at, len(order)).astype(np.int32))
                    lead = order[at]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(h[lead].view(np.int64)), pa.array(g[lead].view(np.int64)), pa.array((last - first)[lead].astype(np.int32)), pa.array((anchor - first)[lead].astype(np.int32)),
                        pa.ListArray.from_arrays(cuts, pa.array(keys[doc[order]])), pa.ListArray.from_arrays(cuts, pa.array(tails[doc[order]])), pa.ListArray.from_arrays(cuts, pa.array((first + a - offsets[doc])[order].astype(np.int32))),
                    ], names=names)

    return docs.select("key", "tail", "text").where(F.octet_length("text") >= length).mapInArrow(run, "h long, g long, more int, ahead int, keys array<long>, tails array<long>, firsts array<int>")


class LogIndex:
    """A family of suffix arrays of fixed-length windows; levels of equal rank merge."""

    def __init__(self) -> None:
        self.levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.matched = np.zeros(0, bool)

    def add(self, windows: np.ndarray) -> None:
        """windows: fixed-length byte strings; their numbers go on from those added before."""
        base = len(self.matched)
        self.matched = np.concatenate([self.matched, np.zeros(len(windows), bool)])
        order = np.argsort(windows, kind="stable")
        keys, ids = windows[order], order + base
        same = keys[1:] == keys[:-1]
        self.matched[ids[1:][same]] = True
        self.matched[ids[:-1][same]] = True
        alone = np.concatenate([[True], ~same]) if len(keys) else np.zeros(0, bool)
        keys, ids, lead = keys[alone], ids[alone], np.cumsum(alone) - 1
        for level_keys, level_ids in self.levels.values():
            at = np.minimum(np.searchsorted(level_keys, keys), len(level_keys) - 1)
            hit = level_keys[at] == keys
            self.matched[level_ids[at[hit]]] = True
            self.matched[base + order[hit[lead]]] = True
        rank = 0
        while rank in self.levels:
            other_keys, other_ids = self.levels.pop(rank)
            keys, ids = np.concatenate([other_keys, keys]), np.concatenate([other_ids, ids])
            order = np.argsort(keys, kind="stable")
            keys, ids = keys[order], ids[order]
            rank += 1
        if len(keys):
            self.levels[rank] = (keys, ids)


def _ranges(matched: np.ndarray, h: np.ndarray, g: np.ndarray, rel: np.ndarray) -> pa.RecordBatch:
    h, g, rel = h[matched], g[matched], rel[matched]
    new = np.ones(len(h), bool)
    if len(h):
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1]) | (rel[1:] != rel[:-1] + 1)
    at = np.flatnonzero(new)
    last = rel[np.append(at[1:], len(rel)) - 1] if len(at) else rel
    return pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array(g[at]), pa.array(rel[at].astype(np.int32)), pa.array(last.astype(np.int32))], names=["h", "g", "a", "b"])


def _pieces(wanted: DataFrame, length: int) -> DataFrame:
    """Runs of one anchor cut by the distance from window to anchor, so that a shard has about FAMILY_WINDOWS windows:
    equal windows have equal distances. Where one distance alone has more, `parts` asks to split it by the windows' bytes.
    wanted: key, tail, h, g, first, more, ahead, need, texts (of the anchor). Adds cut and parts, and rel: where a piece starts
    in its run."""
    span = length - GRAM + 1
    width = F.greatest(F.lit(1), F.least(F.lit(span), F.floor(F.lit(FAMILY_WINDOWS) / F.col("texts")))).cast("int")
    out = wanted.withColumns({"width": width, "parts": F.ceil(F.col("texts") / FAMILY_WINDOWS).cast("int")})
    out = out.withColumn("cut", F.explode(F.sequence(F.floor((F.col("ahead") - F.col("more")) / F.col("width")).cast("int"), F.floor(F.col("ahead") / F.col("width")).cast("int"))))
    most = F.least(F.col("ahead"), F.col("cut") * F.col("width") + F.col("width") - 1)
    least = F.greatest(F.col("ahead") - F.col("more"), F.col("cut") * F.col("width"))
    return out.select("key", "tail", "h", "g", "cut", "parts", (F.col("first") + F.col("ahead") - most).alias("first"), (F.col("ahead") - most).alias("rel"), (most - least).alias("more"), "need")


def _index_shards(texts: DataFrame, length: int) -> DataFrame:
    """texts: h, g, cut, parts, rel, need, body. (h, g, a, b): first and last start, in the run of the description (h, g), of
    windows that match another. A shard is what agrees
    in h, cut and, where it is large, the hash of the one window left; shards stream one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, rows, pending, waiting, last = LogIndex(), [], [], 0, None

        def flush() -> None:
            nonlocal pending, waiting
            if pending:
                family.add(np.concatenate(pending).view(f"S{length}").reshape(-1))
                pending, waiting = [], 0

        def end() -> pa.RecordBatch:
            flush()
            h, g, rel, need, count = (np.concatenate(x) for x in zip(*rows))
            inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            return _ranges(family.matched & np.repeat(need, count), np.repeat(h, count), np.repeat(g, count), np.repeat(rel, count) + inside)

        for batch in batches:
            if not batch.num_rows:
                continue
            h, cut, part, g, rel, need = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "cut", "part", "g", "rel", "need"))
            body = batch.column("body")
            offsets = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1].astype(np.int64)
            windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(body.buffers()[2], np.uint8), length)
            count = np.diff(offsets) - length + 1
            before = np.concatenate([[0], np.cumsum(count)])
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (cut[1:] != cut[:-1]) | (part[1:] != part[:-1])
            new[0] = (h[0], cut[0], part[0]) != last
            last, borders, i = (h[-1], cut[-1], part[-1]), np.flatnonzero(new), 0
            while i < len(h):
                full = len(family.matched) + waiting > FAMILY_WINDOWS
                if full and new[i]:
                    yield end()
                    family, rows, full = LogIndex(), [], False
                j = max(i + 1, int(np.searchsorted(before, before[i] + BATCH_WINDOWS - waiting)))
                if full:  # up to the next shard at most
                    k = int(np.searchsorted(borders, i, side="right"))
                    j = min(j, int(borders[k])) if k < len(borders) else j
                j = min(j, len(h))
                own = slice(i, j)
                at = np.arange(int(before[j] - before[i])) + np.repeat(offsets[own] - (before[own] - before[i]), count[own])
                pending.append(windows[at])
                waiting += len(at)
                rows.append((h[own], g[own], rel[own], need[own], count[own]))
                if waiting >= BATCH_WINDOWS:
                    flush()
                i = j
        if rows:
            yield end()

    parts = max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("body"), F.col("parts"))).otherwise(0).cast("int")
    shards = texts.withColumn("part", part).select("h", "cut", "part", "g", "rel", "need", "body")
    return shards.repartition(parts, "h", "cut", "part").sortWithinPartitions("h", "cut", "part", "g", "rel").mapInArrow(run, "h long, g long, a int, b int")


def _bodies(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted pieces: h, g, cut, parts, rel, need, body."""
    names = ["h", "g", "cut", "parts", "rel", "need", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in names]
        size = 0

        def give() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

        for batch in batches:
            for text, pieces in zip(*(batch.column(c) for c in ("text", "pieces"))):
                data = text.as_py().encode()
                for r in pieces.as_py():
                    body = data[r["first"] : r["first"] + r["more"] + length]
                    for column, x in zip(out, (r["h"], r["g"], r["cut"], r["parts"], r["rel"], r["need"], body)):
                        column.append(x)
                    size += len(body) + 64
                    if size > 8 << 20:
                        yield give()
                        out, size = [[] for _ in names], 0
        if out[0]:
            yield give()

    grouped = wanted.groupBy("key", "tail").agg(F.collect_list(F.struct("h", "g", "cut", "parts", "first", "rel", "more", "need")).alias("pieces"))
    return docs.select("key", "tail", "text").join(grouped, ["key", "tail"]).select("text", "pieces").mapInArrow(run, "h long, g long, cut int, parts int, rel int, need boolean, body binary")


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """key, tail, first, last: starts of the windows that also start elsewhere. docs: key, tail, text (not null)."""
    spark = docs.sparkSession
    # Runs have a row for each batch that holds them. What a hot anchor or run has is summed up before its rows meet, and the
    # sums are tables, so that the joins with them read two plain exchanges, which adaptive execution can split.
    every, every_path = materialize(_runs(docs, length), "all-runs")
    shared, shared_path = materialize(every.groupBy("h").agg(F.sum(F.size("keys")).alias("places")).where("places > 1").select("h"), "shared-anchors")
    runs, runs_path = materialize(every.join(shared, "h", "left_semi"), "runs")
    drop_path(spark, every_path, shared_path)
    at = lambda i: F.struct(F.element_at("keys", i).alias("key"), F.element_at("tails", i).alias("tail"), F.element_at("firsts", i).alias("first"))
    classes = runs.groupBy("h", "g").agg(F.sum(F.size("keys")).alias("copies"), F.min("more").alias("more"), F.min("ahead").alias("ahead"), F.min(at(1)).alias("one"), F.max(at(-1)).alias("other"))
    classes, classes_path = materialize(classes, "classes")
    bodies = F.when(F.col("copies") > 1, 2).otherwise(1)
    anchors, anchors_path = materialize(classes.groupBy("h").agg(F.sum(bodies).alias("texts")), "anchors")
    sent = F.array(F.struct("one.*", F.lit(True).alias("need")), F.when(F.col("copies") > 1, F.struct("other.*", F.lit(False).alias("need"))))
    wanted = classes.join(anchors, "h").select("h", "g", "more", "ahead", "texts", F.explode(F.filter(sent, lambda x: x.isNotNull())).alias("x"))
    wanted = wanted.select("x.key", "x.tail", "x.first", "x.need", "h", "g", "more", "ahead", "texts")
    matched, matched_path = materialize(_index_shards(_bodies(docs, _pieces(wanted, length), length), length), "matched")
    drop_path(spark, classes_path, anchors_path)
    # two reads of one piece, from repeated rows, give its ranges twice
    place = F.explode(F.arrays_zip("keys", "tails", "firsts")).alias("p")
    everywhere = runs.join(matched.distinct(), ["h", "g"]).select("a", "b", place).select(F.col("p.keys").alias("key"), F.col("p.tails").alias("tail"), (F.col("p.firsts") + F.col("a")).alias("first"), (F.col("p.firsts") + F.col("b")).alias("last"))
    found, _ = materialize(everywhere, "found")
    drop_path(spark, runs_path, matched_path)
    return found


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes and the removed spans."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    source = source.withColumns({"key": F.xxhash64("doc_id", "text"), "tail": F.xxhash64(F.lit(1), "text", "doc_id")})
    found = repeated_windows(source.select("key", "tail", "text"), length)
    grouped = found.groupBy("key", "tail").agg(F.collect_set(F.struct("first", "last")).alias("found"))
    joined = source.join(grouped, ["key", "tail"], "left").select("doc_id", "text", "found")
    more = [T.StructField("kept", T.BinaryType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())))] if with_kept else []
    kinds = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType())]
    schema = T.StructType([source.schema["doc_id"], *(T.StructField(n, t) for n, t in kinds), *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("found")
            out: list[list] = [[], [], [], [], [], []]
            for i, text in enumerate(batch.column("text")):
                data, spans, hits = text.as_buffer(), [], found[i]
                kept = raw = data.to_pybytes()
                if hits.is_valid:
                    first, last = (hits.values.field(k).to_numpy() for k in (0, 1))
                    edge = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(edge, first, 1)
                    np.add.at(edge, last + length, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    spans = turns.reshape(-1, 2).tolist()
                for column, x in zip(out, (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept, spans)):
                    column.append(x)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.list_(pa.int64()))][: 6 if with_kept else 4]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, types))], names=schema.names)

    return joined.mapInArrow(run, schema)


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, s, md5(substr(x, 2 * s + 1, 400)) AS k FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 199)) AS s FROM d WHERE length(x) >= 400)),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY k) AS copies FROM w) WHERE copies > 1),
e AS (SELECT doc_id, p, sum(turn) AS turn FROM (SELECT doc_id, s AS p, 1 AS turn FROM r UNION ALL SELECT doc_id, s + 200, -1 FROM r UNION ALL SELECT doc_id, unnest(range(0, length(x) // 2)), 0 FROM d) GROUP BY doc_id, p),
g AS (SELECT doc_id, p, sum(turn) OVER (PARTITION BY doc_id ORDER BY p) > 0 AS gone FROM e),
h AS (SELECT doc_id, p, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS first FROM g),
k AS (SELECT h.doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (first) AS n_spans, string_agg(substr(d.x, 2 * p + 1, 2), '' ORDER BY p) FILTER (NOT gone) AS kept FROM h JOIN d ON h.doc_id = d.doc_id WHERE 2 * p < length(d.x) GROUP BY h.doc_id)
SELECT d.doc_id, CAST(length(d.x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(k.n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.kept, ''))) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
