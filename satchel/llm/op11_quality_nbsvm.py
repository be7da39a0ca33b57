"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Features of a whole text, each there or not, in 2^18 hashed buckets: three bytes in a row, words, two words in a row, and which of
four words in a row are equal (so that echoed words are told whatever they are). Each indicator is scaled by the log of the ratio
of its (smoothed) counts in the two classes, texts are scaled to length one, and a linear model with hinge loss is fitted by dual
coordinate descent. Margins become probabilities by a logistic curve, fitted on margins of parts of the sample that the model in
question was not fitted on.

The model is fitted on the driver, on at most sample_rows labelled documents (those of the smallest hashes of their ids, taken
after the join with documents) with at most sample_features indicators together; both bounds are parameters. All documents are
scored, in Arrow batches, with a weight for each bucket; nothing else is broadcast.

Null and empty texts have no features and get the score of the model's constant. Of several labels of one id the smallest counts;
null labels are none. Equal rows with one id count once in the sample; every row is scored. Without labels the score is 0.5
everywhere, with labels of one class alone (count + 1) / (rows + 2). A null id reads as empty text where its checksum is taken.
An empty table gives no rows. Columns of the input with the name of a new one are replaced. A word of over a megabyte is read in
parts of that size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, materialize, slices, texts_of

BUCKETS = 1 << 18
#: Bytes of text that are taken apart at once.
PIECE_BYTES = 1 << 20
SAMPLE_ROWS, SAMPLE_FEATURES = 6000, 40_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_VISIBLE = bytes(b for b in range(256) if not _BLANK[b])
_CODES = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) ^ (np.arange(1, 257, dtype=np.uint64) << np.uint64(17))
with np.errstate(over="ignore"):
    _POWERS = np.cumprod(np.full(2 * PIECE_BYTES + 2, _ODD, np.uint64))
    _BACK = np.cumprod(np.full(2 * PIECE_BYTES + 2, np.uint64(pow(int(_ODD), -1, 1 << 64)), np.uint64))


def _bucket(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(46)).astype(np.int64)


def _pairs(data: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The distinct row * BUCKETS + bucket of texts that stand one after another, each ended by a blank; row: of each byte."""
    wide = data.astype(np.uint64)
    found = []
    if len(data) > 2:
        three = (wide[:-2] << np.uint64(16)) | (wide[1:-1] << np.uint64(8)) | wide[2:]
        own = row[:-2] == row[2:]
        found.append(row[:-2][own] * BUCKETS + _bucket(three[own], 1))
    blank = _BLANK[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]])))
    start, end = edges[::2], edges[1::2]
    if len(start):
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODES[data] * _POWERS[: len(data)])])
            word = (sums[end] - sums[start]) * _BACK[start]
            word ^= (end - start).astype(np.uint64)
            own = row[start]
            found.append(own * BUCKETS + _bucket(word, 2))
            same = own[1:] == own[:-1]
            found.append((own[1:] * BUCKETS + _bucket(word[:-1] * _ODD + word[1:], 3))[same])
        if len(word) > 3:
            n, shape, bit = len(word) - 3, np.zeros(len(word) - 3, np.uint64), 0
            for a in range(3):
                for b in range(a + 1, 4):
                    shape |= (word[a : a + n] == word[b : b + n]).astype(np.uint64) << np.uint64(bit)
                    bit += 1
            found.append((own[3:] * BUCKETS + _bucket(shape, 4))[own[3:] == own[:-3]])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _cuts(raw: bytes) -> Iterator[bytes]:
    """A long text in pieces that end behind a blank and start before the last three words of the piece before, so that every n-gram is
    in one; the last ends with a blank of its own. A word that fills a piece is cut."""
    at = 0
    while len(raw) - at > PIECE_BYTES:
        end = at + PIECE_BYTES
        piece = raw[at:end]
        cut = len(piece.rstrip(_VISIBLE))
        if cut:
            piece, end = piece[:cut], at + cut
        words = piece.rsplit(None, 3)
        yield piece
        after = at + len(words[0]) if len(words) == 4 else end - 2
        at = after if after > at else end - 2
    yield raw[at:] + b" "


def indicators(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the indicators of each text, each once, in order."""
    out, waiting, numbers, size = [], [], [], 0

    def take() -> None:
        nonlocal size
        if waiting:
            lengths = np.fromiter((len(x) + 1 for x in waiting), np.int64, len(waiting))
            out.append(_pairs(np.frombuffer(b" ".join([*waiting, b""]), np.uint8), np.repeat(np.array(numbers, np.int64), lengths)))
            waiting.clear()
            numbers.clear()
            size = 0

    for i, raw in enumerate(texts.cast(pa.binary()).to_pylist()):
        if len(raw) > PIECE_BYTES:
            take()
            out.append(np.unique(np.concatenate([_pairs(np.frombuffer(x, np.uint8), np.full(len(x), i, np.int64)) for x in _cuts(raw)])))
            continue
        if size + len(raw) >= PIECE_BYTES:
            take()
        waiting.append(raw)
        numbers.append(i)
        size += len(raw) + 1
    take()
    pairs = np.concatenate(out) if out else np.zeros(0, np.int64)
    return pairs // BUCKETS, pairs % BUCKETS


@dataclass(frozen=True)
class Model:
    """Margins are constant + sum of weight / norm, with norm the root of the sum of square over a text's indicators."""

    weight: np.ndarray
    square: np.ndarray
    constant: float
    slope: float
    offset: float

    def margins(self, row: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        total = np.bincount(row, self.weight[bucket], n)
        norm = np.sqrt(np.bincount(row, self.square[bucket], n))
        return self.constant + total / np.where(norm > 0, norm, 1)

    def scores(self, texts: pa.Array) -> np.ndarray:
        row, bucket = indicators(texts)
        x = self.slope * self.margins(row, bucket, len(texts)) + self.offset
        return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _ratios(rows: list[np.ndarray], good: np.ndarray, smoothing: float) -> np.ndarray:
    counts = []
    for own in (good, ~good):
        picked = [rows[i] for i in np.flatnonzero(own)]
        count = smoothing + (np.bincount(np.concatenate(picked), minlength=BUCKETS) if picked else np.zeros(BUCKETS))
        counts.append(np.log(count / count.sum()))
    return counts[0] - counts[1]


def fit_margins(rows: list[np.ndarray], good: np.ndarray, cost: float = 4.0, epochs: int = 12, smoothing: float = 1.0, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """(weight, square, constant) by dual coordinate descent: each step solves for one row's multiplier, between 0 and cost."""
    ratio = _ratios(rows, good, smoothing)
    square = ratio * ratio
    y = np.where(good, 1.0, -1.0)
    values = []
    for own in rows:
        norm = np.sqrt(square[own].sum())
        values.append(ratio[own] / norm if norm > 0 else np.zeros(len(own)))
    lengths = np.array([float(v @ v) + 1 for v in values])  # 1: the constant's indicator
    w, constant, multiplier = np.zeros(BUCKETS), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(len(rows)).tolist():
            own, v = rows[i], values[i]
            slope = y[i] * (w[own] @ v + constant) - 1
            after = min(max(multiplier[i] - slope / lengths[i], 0.0), cost)
            step = (after - multiplier[i]) * y[i]
            if step:
                multiplier[i] = after
                w[own] += step * v
                constant += step
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w * ratio, square, constant


def _logistic(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the curve from margins to probabilities, by Newton steps, with targets short of 0 and 1."""
    n1, n0 = int(good.sum()), int((~good).sum())
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -50, 50)))
        g = np.array([((p - target) * margin).sum() + 1e-3 * a, (p - target).sum()])
        s = np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(s * margin * margin).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 0.0), float(b)


def fit(rows: list[np.ndarray], good: np.ndarray, folds: int = 3, **options) -> Model:
    """rows: the buckets of each text, each once; good: its class."""
    n, n1 = len(rows), int(good.sum())
    zero = np.zeros(BUCKETS)
    if n1 in (0, n):
        share = 0.5 if n == 0 else (n1 + 1) / (n + 2)
        return Model(zero, zero, 0.0, 0.0, float(np.log(share / (1 - share))))
    fold, margin = np.arange(n) % folds, np.zeros(n)
    for k in range(folds):
        inside = np.flatnonzero(fold != k)
        if 0 < good[inside].sum() < len(inside):
            weight, square, constant = fit_margins([rows[i] for i in inside], good[inside], **options)
            for i in np.flatnonzero(fold == k):
                norm = np.sqrt(square[rows[i]].sum())
                margin[i] = constant + (weight[rows[i]].sum() / norm if norm > 0 else 0)
    return Model(*fit_margins(rows, good, **options), *_logistic(margin, good))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int, sample_features: int) -> tuple[list[np.ndarray], np.ndarray]:
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).cast("int").alias("__label"))
    there = marked.join(docs.select(F.col(id_col).alias("__id")), "__id", "left_semi")
    chosen, _ = materialize(there.orderBy(F.xxhash64("__id"), "__id").limit(sample_rows), "labelled")
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "__id")  # sample_rows rows at most

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                row, bucket = indicators(texts_of(batch, "text"))
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(bucket.astype(np.int32)))], names=["id", "label", "buckets"])

    kind = chosen.schema["__id"].dataType.simpleString()
    rows = texts.select("__id", "__label", "text").mapInArrow(taken, f"id {kind}, label int, buckets array<int>")
    rows = rows.withColumns({"h": F.xxhash64("id"), "g": F.xxhash64("buckets"), "n": F.size("buckets")}).dropDuplicates(["id", "g"])
    rows, _ = materialize(rows.orderBy("h", "g").limit(sample_rows), "indicators")
    sizes = rows.select("h", "g", "n").orderBy("h", "g").collect()
    fits = int(np.searchsorted(np.cumsum([x.n for x in sizes]), sample_features, side="right")) if sizes else 0
    if fits < len(sizes):
        last = sizes[max(fits - 1, 0)]
        rows = rows.where((F.col("h") < last.h) | ((F.col("h") == last.h) & (F.col("g") <= last.g)))
    found = rows.orderBy("h", "g").select("label", "buckets").toArrow()
    buckets = found.column("buckets").combine_chunks()
    flat, ends = buckets.flatten().to_numpy(), np.concatenate([[0], np.cumsum(buckets.value_lengths().to_numpy(zero_copy_only=False))]) if len(buckets) else np.zeros(1)
    return [flat[int(a) : int(b)] for a, b in zip(ends, ends[1:])], found.column("label").to_numpy() >= 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_features: int = SAMPLE_FEATURES, **options) -> Model:
    """The model of at most sample_rows labelled documents (label 1: good)."""
    return fit(*_sample(docs, labels, id_col, text_col, label_col, sample_rows, sample_features), **options)


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """docs with score and predicted (1 from the threshold on)."""
    out = append_columns(docs, text_col, [("score", T.DoubleType())], lambda: lambda texts: [pa.array(model.scores(texts), pa.float64())], keep)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(id_col: str = "doc_id"):
    """True for a quarter of all ids, by their checksum."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2
