"""SimHash near-duplicate detection with pivot distance tables.

Fingerprint: bit b of the 64 is set if over half of the text's shingle hashes (XXH64, seed 42, repeats included) have it.
Two fingerprints are linked if at most `radius` bits differ; a component is what is reachable over links.

Search. The Hamming distances of each distinct fingerprint to a fixed table of reference fingerprints (pivots) are computed
once and travel with it. By the triangle inequality two linked fingerprints differ by at most `radius` in every coordinate:
a pair with a larger difference in any is discarded, and the survivors are verified bit by bit. A coordinate alone lets over
half of all pairs pass, so the tables work inside exact blocks: the 64 bits are cut into `segments` parts, linked fingerprints
agree in at least segments - radius of them, and each choice of so many parts is a key. All links lie in some block; none is
lost. There are as few segments as keep blocks at about BLOCK_GOAL fingerprints, so the key is coarse and the pivots do the
discarding. A block is in order of the first coordinate, and only neighbours within `radius` of it become candidates.

Groups of copies: equal fingerprints are one row from the start. Links of a block leave as at most one edge a member. Large
blocks are walked from member to member, and what has been reached is taken out of the search; those of over `block_rows`
members are dealt out as pairs of chunks. Components come from alternating large and small stars over these edges, as joins.

Null and empty texts have fingerprint zero and are linked like any other. Rows with equal doc_id are kept. A null doc_id is
passed over in a component's smallest id; a component of null ids alone has a null component_id. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import append_columns, drop_path, materialize

SEED = 42
RADIUS = 4
#: Fingerprints in a block on average, up to which a key of fewer bits is taken.
BLOCK_GOAL = 64
BLOCK_ROWS = 20_000
#: Blocks of more members are walked.
WALK_ROWS = 1_000
#: Reference fingerprints: hashes of the numbers 0 to 15.
PIVOTS = np.array([xxh64_intdigest(str(i), 7) for i in range(16)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; zero for none."""
    ones = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, width: int = 4) -> int:
    words = text.encode().lower().split()  # bytes: ASCII only, both the case and the white space
    n = len(words)
    if n == 0:
        return 0
    line = b" ".join(words)
    if n <= width:
        return xxh64_intdigest(line, SEED)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    shingles = [line[a:b] for a, b in zip([0, *(e + 1 for e in ends)], ends[width - 1 :])]
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))
    return majority(hashes)


def fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fp", width: int = 4, keep: list[str] | None = None) -> DataFrame:
    """docs with a signed 64-bit fingerprint column."""

    def run(texts: pa.Array) -> list[pa.Array]:
        return [pa.array(np.array([fingerprint(t, width) for t in texts.to_pylist()], np.uint64).view(np.int64), pa.int64())]

    return append_columns(docs, text_col, [(out_col, T.LongType())], lambda: run, keep)


def _masks(segments: int, radius: int) -> list[int]:
    """Masks of the bits in each choice of segments - radius segments, as signed 64-bit integers."""
    edges = [round(64 * k / segments) for k in range(segments + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = [sum(parts[i] for i in own) for own in combinations(range(segments), segments - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def segments_for(fingerprints: int, radius: int = RADIUS) -> int:
    """The fewest segments whose keys hold BLOCK_GOAL of so many fingerprints or fewer, were these spread evenly."""
    agree = 1
    while agree < 40 and fingerprints > BLOCK_GOAL * 2 ** (64 * agree / (radius + agree)):
        agree += 1
    return radius + agree


def pivot_table(values: np.ndarray) -> np.ndarray:
    """A row for each value: its Hamming distances to the pivots."""
    return np.bitwise_count(values[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def with_pivots(values: DataFrame) -> DataFrame:
    """values (fp, ...) with pivots: a byte for each coordinate of the fingerprint's row of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pivot_table(batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(PIVOTS)), len(table), [None, pa.py_buffer(np.ascontiguousarray(table))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, packed], names=[*batch.schema.names, "pivots"])

    return values.mapInArrow(run, T.StructType([*values.schema.fields, T.StructField("pivots", T.BinaryType())]))


def _near(values: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, seen: dict | None = None) -> np.ndarray:
    """Places of the pairs (a, b) that are linked: coordinate by coordinate, then bit by bit. seen: counts of pairs."""
    left = np.arange(len(a))
    for k in range(1, table.shape[1]):  # the first coordinate has made the pairs
        if not len(left):
            break
        left = left[np.abs(table[a[left], k] - table[b[left], k]) <= radius]
    linked = left[np.bitwise_count(values[a[left]] ^ values[b[left]]) <= radius]
    if seen is not None:
        for name, n in (("candidates", len(a)), ("verified", len(left)), ("linked", len(linked))):
            seen[name] = seen.get(name, 0) + n
    return linked


def _walk(values: np.ndarray, table: np.ndarray, radius: int, seen: dict | None) -> Iterator[tuple[int, np.ndarray]]:
    """(root, members reached from it) for the components of one block, which is in order of the first coordinate."""
    open_at = np.arange(len(values))
    while len(open_at) > 1:
        root, frontier, open_at = int(open_at[0]), [int(open_at[0])], open_at[1:]
        reached = []
        while frontier and len(open_at):
            x = frontier.pop()
            own = table[open_at, 0]
            low, high = np.searchsorted(own, table[x, 0] - radius), np.searchsorted(own, table[x, 0] + radius, side="right")
            hit = low + _near(values, table, np.full(high - low, x), open_at[low:high], radius, seen)
            if len(hit):
                new = open_at[hit]
                reached.append(new)
                frontier += new.tolist()
                open_at = np.delete(open_at, hit)
        if reached:
            yield root, np.concatenate(reached)


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from one node of each component of the edges (a, b) to its others."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        label = label[label]
        if np.array_equal(label, before):
            rest = np.flatnonzero(label != np.arange(len(nodes)))
            return nodes[label[rest]], nodes[rest]


def _block_edges(keys: np.ndarray, values: np.ndarray, table: np.ndarray, radius: int, seen: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges inside blocks; equal neighbours in `keys` are a block, in order of the first coordinate."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    out_a, out_b, k = [], [], 1
    a = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= WALK_ROWS), sizes))
    while len(a):
        a = a[a + k < len(keys)]
        a = a[(keys[a + k] == keys[a]) & (table[a + k, 0] - table[a, 0] <= radius)]
        hit = _near(values, table, a, a + k, radius, seen)
        out_a.append(values[a[hit]])
        out_b.append(values[a[hit] + k])
        k += 1
    if out_a:
        stars = _stars(np.concatenate(out_a), np.concatenate(out_b))
        out_a, out_b = [stars[0]], [stars[1]]
    for s in np.flatnonzero(sizes > WALK_ROWS).tolist():
        own = slice(starts[s], starts[s] + sizes[s])
        for root, reached in _walk(values[own], table[own], radius, seen):
            out_a.append(np.full(len(reached), values[own][root], np.uint64))
            out_b.append(values[own][reached])
    empty = np.zeros(0, np.uint64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (empty, empty)


def links(values: DataFrame, radius: int = RADIUS, segments: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that join exactly the components of the link graph. values: fp (long) and
    pivots; they are counted, unless the number of segments is given."""
    masks = _masks(segments or segments_for(values.count(), radius), radius)
    keyed = values.select("fp", "pivots", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for k, m in enumerate(masks)])).alias("b")).select("b.k", "b.v", "fp", "pivots")
    sizes = keyed.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    cells = keyed.join(sizes, ["k", "v"]).withColumn("chunks", F.ceil(F.col("n") / block_rows).cast("int"))
    cells = cells.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = cells.select("k", "v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "pivots")
    parts = max(1, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = cells.repartition(parts, "k", "v", "i", "j").sortWithinPartitions("k", "v", "i", "j", "pivots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(*held: np.ndarray) -> pa.RecordBatch:
            a, b = _block_edges(*held, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        held, last = [], None  # rows of blocks that may go on, and the last row's block
        number = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "v", "i", "j")]
            values = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            table = np.frombuffer(b"".join(batch.column("pivots").to_pylist()), np.int8).reshape(len(values), -1)
            new = np.ones(len(values), bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
            new[0] = tuple(int(c[0]) for c in cols) != last
            keys = number + np.cumsum(new)
            number, last = int(keys[-1]), tuple(int(c[-1]) for c in cols)
            held.append((keys, values, table))
            keys, values, table = (np.concatenate([h[x] for h in held]) for x in range(3))
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield give(keys[:cut], values[:cut], table[:cut])
            held = [(keys[cut:], values[cut:], table[cut:])]
        if held:
            yield give(*held[0])

    return ordered.mapInArrow(run, "a long, b long").where("a <> b").dropDuplicates(["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of the edges (a, b): root is the smallest node of the component."""
    spark, paths = edges.sparkSession, []

    def kept(df: DataFrame) -> DataFrame:
        out, path = materialize(df, "components")
        paths.append(path)
        return out

    now = kept(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        # large star: the larger neighbours of a node move to the smallest of its neighbourhood
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours move to the smallest of these
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = kept(moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        drop_path(spark, *paths[:-1])
        del paths[:-1]
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, width: int = 4, segments: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of each row."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows, _ = materialize(fingerprints(source, "text", "fp", width, keep=["doc_id"]), "fingerprints")
    classes, classes_path = materialize(with_pivots(rows.groupBy("fp").agg(F.min("doc_id").alias("least"))), "classes")
    tied, tied_path = materialize(components(links(classes.select("fp", "pivots"), radius, segments)), "tied")
    tied = tied.withColumnRenamed("node", "fp").join(classes.select("fp", "least"), "fp")
    smallest = tied.groupBy("root").agg(F.min("least").alias("smallest"))
    tied = tied.join(smallest, "root").select("fp", "smallest")
    named, _ = materialize(classes.select("fp", "least").join(tied, "fp", "left").select("fp", F.coalesce("smallest", "least").alias("component_id")), "named")
    drop_path(spark, classes_path, tied_path)
    out = rows.join(named, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, width: int = 4) -> DataFrame:
    """One document of each component: that of the smallest id (all rows with that id and text, if they are repeated). A null
    id comes after all others; of a component with null ids alone one row stays."""
    key = F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"))
    keyed = docs.withColumn("__key", key)
    chosen = near_duplicates(keyed, "__key", text_col, radius, width).where("doc_id = component_id").select(F.col("doc_id").alias("__id")).distinct()
    named = keyed.where(F.col(id_col).isNotNull())
    nameless = keyed.where(F.col(id_col).isNull()).dropDuplicates(["__key"])
    return named.unionByName(nameless).join(chosen, F.col("__key") == F.col("__id"), "left_semi").drop("__key")
