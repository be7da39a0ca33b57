"""Near-duplicate texts by the Jaccard similarity of their sets of word shingles.

Texts with equal sets are one class from the start. Two classes are linked if their similarity is `similarity` or more; a
component is what is reachable over links. First come the neighbours by SimHash: each set has a fingerprint, and those that differ in
few bits are found by op3's pivot tables and compared in full. A pair of similarity 0.8 differs in about ten of 64 bits, which
no such search reaches, so the links it leaves are found by bands, between sets that it did not bring together: BANDS keys of ROWS minimum hashes each, so that a pair of
similarity 0.8 shares none with a probability of (1 - 0.8^5)^36, below 1e-6 and less for closer pairs. A candidate is linked
only if its shingle sets, intersected in full, are similar enough.

Groups of copies: each member of a band's block is compared with the block's smallest member; a group of near copies gives
about one pair a member, and blocks that are one component then are done. What is left, texts that share a passage for the
most part, is cut by set size (similar sets differ by a factor of 1.25 at most), dealt out in pairs of chunks of bounded
shingles, and each cell is compared in one place by a product of its incidence matrix: no pair leaves it but links.

Null, empty and blank texts have no shingles and are one class. Texts of fewer words than a shingle are one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import append_columns, drop_path, materialize, release_memory
from .op03_simhash import SEED, components, links, majority, with_pivots

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 36, 5
#: Sets, and shingles of them, in a chunk of a block.
CHUNK_SETS, CHUNK_SHINGLES = 256, 400_000
_FACTORS = np.array([xxh64_intdigest(str(i), 11) | 1 for i in range(BANDS * ROWS)], np.uint64)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of the text's runs of `width` words, ascending."""
    words = text.encode().lower().split()  # bytes: ASCII only, both the case and the white space
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    runs = [line[a:b] for a, b in zip([0, *(e + 1 for e in ends)], ends[width - 1 :])] or [line]
    return np.unique(np.fromiter(map(xxh64_intdigest, runs, repeat(SEED)), np.uint64, len(runs)))


def _bands(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS keys for each set; none of the sets is empty."""
    flat, starts = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    keys = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), band + 1, np.uint64)
        for factor in _FACTORS[band * ROWS : (band + 1) * ROWS]:
            key = (key ^ np.minimum.reduceat(flat * factor, starts)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        keys[:, band] = key
    return keys.view(np.int64)


def _described(docs: DataFrame, width: int) -> DataFrame:
    """docs (doc_id, th, text) to doc_id, th, set (name of the shingle set), size, fp (the set's SimHash) and bands."""

    def run(texts: pa.Array) -> list[pa.Array]:
        sets = [shingles(t, width) for t in texts.to_pylist()]
        names = np.array([xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
        prints = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
        full = [s for s in sets if len(s)]
        rows = iter(_bands(full) if full else ())
        bands = [next(rows) if len(s) else None for s in sets]
        return [pa.array(names), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints), pa.array(bands, pa.list_(pa.int64()))]

    fields = [("set", T.LongType()), ("size", T.LongType()), ("fp", T.LongType()), ("bands", T.ArrayType(T.LongType()))]
    return append_columns(docs, "text", fields, lambda: run, ["doc_id", "th"])


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of which the sets are similar enough."""
    both = pairs.join(sets.select(F.col("set").alias("a"), F.col("data").alias("x")), "a").join(sets.select(F.col("set").alias("b"), F.col("data").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(p, q, assume_unique=True))
                near.append(common >= similarity * (len(p) + len(q) - common) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))
        release_memory()

    return both.mapInArrow(run, "a long, b long")


def _neighbours(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets whose fingerprints are linked by op3's search, one edge a member; equal ones with their smallest set."""
    full = classes.where("size > 0")
    heads, _ = materialize(with_pivots(full.groupBy("fp").agg(F.min("set").alias("hub"))), "heads")
    equal = full.join(heads.select("fp", "hub"), "fp").where("set <> hub").select(F.col("hub").alias("a"), F.col("set").alias("b"))
    end = lambda c: heads.select(F.col("fp").alias(c), F.col("hub").alias(f"{c}_hub"))
    close = links(heads.select("fp", "pivots")).join(end("a"), "a").join(end("b"), "b")
    return equal.unionByName(close.select(F.least("a_hub", "b_hub").alias("a"), F.greatest("a_hub", "b_hub").alias("b"))).distinct()


def _edges(classes: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links (a, b) between shingle sets that join exactly the components over similar pairs that are neighbours by SimHash or share a
    band."""
    near, _ = materialize(_neighbours(classes), "simhash")
    blocks, blocks_path = materialize(classes.select("set", "size", F.explode("bands").alias("key")), "bands")
    hubs = blocks.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("set").alias("hub")).where("n > 1").select("key", "hub")
    members, _ = materialize(blocks.join(hubs, "key"), "members")
    drop_path(classes.sparkSession, blocks_path)
    wanted = members.select("set").unionByName(near.select(F.explode(F.array("a", "b")).alias("set"))).distinct().join(classes.select("set", "th"), "set")
    texts = docs.select("th", "text").join(wanted.select("th"), "th", "left_semi").dropDuplicates(["th"]).join(wanted, "th").select("set", "text")

    def run(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([shingles(t, width).tobytes() for t in texts.to_pylist()], pa.binary())]

    sets, _ = materialize(append_columns(texts, "text", [("data", T.BinaryType())], lambda: run, ["set"]), "sets")
    alike, _ = materialize(_verified(near, sets, similarity), "alike")
    known, _ = materialize(components(alike), "known")
    root = lambda c: known.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    first = members.where("set <> hub").select(F.col("hub").alias("a"), F.col("set").alias("b")).distinct().join(root("a"), "a", "left").join(root("b"), "b", "left")
    first, _ = materialize(first.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b"), "pairs")
    linked, _ = materialize(alike.unionByName(_verified(first, sets, similarity)), "linked")
    tied, _ = materialize(components(linked), "tied")
    placed = members.join(tied.withColumnRenamed("node", "set"), "set", "left").select("key", "set", "size", F.coalesce("root", "set").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    left, _ = materialize(placed.join(mixed, "key", "left_semi"), "unlinked")
    return linked.unionByName(_cell_links(left, sets, similarity))


def _alike(sets: list[np.ndarray], roots: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of sets that are similar enough, one for each two roots."""
    m, sizes = len(sets), np.array([len(s) for s in sets])
    columns, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    row, column = np.repeat(np.arange(m), sizes)[shared[inverse]], number[inverse[shared[inverse]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((m, m), np.float32)
    for first in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(column, (first, first + 4096))
        part = np.zeros((m, 4096), np.float32)
        part[row[a:b], column[a:b] - first] = 1
        common += part @ part.T
    near = common >= similarity * (sizes[:, None] + sizes[None, :] - common) - 1e-6
    x, y = np.nonzero(np.triu(near & (roots[:, None] != roots[None, :]), 1))
    _, one = np.unique(np.stack([np.minimum(roots[x], roots[y]), np.maximum(roots[x], roots[y])]), axis=1, return_index=True)
    return x[one], y[one]


def _cell_links(left: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between sets of one block that are not in one component. left: key, set, size, root."""
    step = F.lit(1 / (0.99 * similarity))  # wider than need be, so that rounding puts no similar sets two steps apart
    own = F.floor(F.log("size") / F.log(step)).cast("int")
    cells = left.withColumn("own", own).withColumn("cell", F.explode(F.array("own", F.col("own") + 1)))
    sizes = cells.groupBy("key", "cell").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK_SETS), F.ceil(F.sum("size") / CHUNK_SHINGLES)).cast("int").alias("chunks"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("own").alias("top"))
    cells = cells.join(sizes.where("lo <> hi and top = cell").select("key", "cell", "chunks"), ["key", "cell"])
    cells = cells.withColumn("part", F.pmod(F.xxhash64("set"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = cells.select("key", "cell", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "set", "root")
    parts = max(1, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    full = cells.join(sets, "set").select("key", "cell", "i", "j", "set", "root", "data")
    ordered = full.repartition(parts, "key", "cell", "i", "j").sortWithinPartitions("key", "cell", "i", "j", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None

        def give() -> pa.RecordBatch:
            names, roots = np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64)
            x, y = _alike([np.frombuffer(h[2], np.uint64) for h in held], roots, similarity)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(names[x], names[y])), pa.array(np.maximum(names[x], names[y]))], names=["a", "b"])

        for batch in batches:
            for *cell, name, root, data in zip(*(batch.column(c).to_pylist() for c in ("key", "cell", "i", "j", "set", "root", "data"))):
                if cell != last and held:
                    yield give()
                    held = []
                last = cell
                held.append((name, root, data))
        if held:
            yield give()
        release_memory()

    return ordered.mapInArrow(run, "a long, b long").distinct()


def keep_first_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """One document of each component: that of the smallest id (all rows with that id and text, if they are repeated). A null
    id comes after all others; of a component with null ids alone one row stays."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    rows, _ = materialize(_described(source, width), "shingled")
    classes, _ = materialize(rows.groupBy("set").agg(F.min("doc_id").alias("least"), F.min("th").alias("th"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "classes")
    linked, _ = materialize(_edges(classes, source, width, similarity), "links")
    tied, _ = materialize(components(linked), "tied")
    named = classes.select("set", "least").join(tied.withColumnRenamed("node", "set"), "set", "left").select("set", "least", F.coalesce("root", "set").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("smallest"))
    found = rows.select("doc_id", "th", "set").join(named.join(smallest, "root").select("set", "root", "smallest"), "set")
    chosen = found.where("doc_id = smallest").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct()
    lone = found.where("smallest is null").groupBy("root").agg(F.min("th").alias("__th")).select("__th")
    keyed = docs.withColumn("__h", F.xxhash64(text_col))
    known = keyed.join(chosen, (F.col(id_col) == F.col("__id")) & (F.col("__h") == F.col("__th")), "left_semi")
    nameless = keyed.where(F.col(id_col).isNull()).dropDuplicates(["__h"]).join(lone, F.col("__h") == F.col("__th"), "left_semi")
    return known.unionByName(nameless).drop("__h")
