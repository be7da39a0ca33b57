"""Toxicity: cumulative-link ordinal regression over sparse text features.

The model has one weight vector shared by all thresholds: P(grade <= k) = 1 / (1 + exp(w.x - t_k)), with t_1 < t_2 < ...
Grades are 0 (none), 1 (mild), 2 (strong), 3 (severe). Its outputs are the expected severity (the sum of P(grade > k)), the
probability of any toxicity, and the likeliest grade.

Features are log(1 + count) of a fixed vocabulary of words (runs of letters, lower case) and of the first letters of longer
words. The vocabulary is chosen from labelled texts by how much more often a term stands in toxic ones; it is counted once for
each word before it, so copies of one text don't make its words look typical.

Labels above 1 are grades and are taken as they are (at most 3). Where all labels are 0 or 1, toxic texts are graded by cross
fitting: the labelled texts are halved by the hash of their id, the words that speak for toxicity are found in each half, and a
text is graded by how many of the other half's words stand in it, cut at the terciles. So no text's label has a part in its
own grade, and the words that grade it are not those that its own half brings into the model.

Training uses at most sample_rows labelled documents, read once; scoring covers all texts whole. Null and empty texts have no
features. Of several labels of one id the largest counts; null labels don't. Rows with equal doc_id are each labelled and
each scored. No labels, or labels of one kind, give a model without features that rejects nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, drop_path, materialize, split_words

GRADES = 4
_LETTERS = re.compile(r"[^\W\d_]+")
STEM = 5


def terms(word: str) -> tuple[str, ...]:
    """The features that a word counts for: itself, and its first letters if it is longer."""
    return (word, word[:STEM] + "*") if len(word) > STEM else (word,)


@dataclass(frozen=True)
class Model:
    vocabulary: tuple[str, ...]
    weights: np.ndarray
    thresholds: np.ndarray

    def over(self, features: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and threshold."""
        z = features @ self.weights if len(self.weights) else np.zeros(len(features))
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -40, 40)))


def loss(p: np.ndarray, x: np.ndarray, grade: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """Negative log likelihood of the grades with l2 / 2 |w|^2, and its gradient. p: the weights, the first threshold, and the
    logarithms of the thresholds' distances."""
    n, m = x.shape
    rows, gaps = np.arange(n), np.exp(p[m + 1 :])
    t = p[m] + np.concatenate([[0.0], np.cumsum(gaps)])
    z = x @ p[:m]
    below = 1 / (1 + np.exp(np.clip(z[:, None] - t[None, :], -40, 40)))  # P(grade <= k)
    full = np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], axis=1)
    slope = np.concatenate([np.zeros((n, 1)), below * (1 - below), np.zeros((n, 1))], axis=1)
    mass = np.maximum(full[rows, grade + 1] - full[rows, grade], 1e-9)
    upper, lower = slope[rows, grade + 1] / mass, slope[rows, grade] / mass
    g = np.zeros_like(p)
    g[:m] = x.T @ (upper - lower) + l2 * p[:m]
    by_t = np.zeros(GRADES - 1)
    np.add.at(by_t, np.minimum(grade, GRADES - 2), np.where(grade < GRADES - 1, -upper, 0))
    np.add.at(by_t, np.maximum(grade - 1, 0), np.where(grade > 0, lower, 0))
    g[m] = by_t.sum()
    g[m + 1 :] = np.cumsum(by_t[::-1])[::-1][1:] * gaps
    return float(-np.log(mass).sum() + l2 / 2 * (p[:m] ** 2).sum()), g


def fit(x: np.ndarray, grade: np.ndarray, l2: float = 0.3, rounds: int = 400, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by full-batch Adam on the cumulative-link likelihood; thresholds are kept in order by
    fitting the logarithms of their distances."""
    n, m = x.shape
    share = np.array([(grade <= j).mean() for j in range(GRADES - 1)]).clip(1 / (n + 2), 1 - 1 / (n + 2))
    first = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(m), first[:1], np.log(np.maximum(np.diff(first), 0.05))])
    mean, square = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, rounds + 1):
        _, g = loss(p, x, grade, l2)
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        p -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return p[:m], p[m] + np.concatenate([[0.0], np.cumsum(np.exp(p[m + 1 :]))])


def _features(texts: pa.Array, index: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, count) of all vocabulary words in the texts."""
    rows, words = split_words(texts)
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    pairs = [(i, index[x]) for i, s in enumerate(coded.dictionary.to_pylist()) for w in _LETTERS.findall(s.lower()) for x in terms(w) if x in index]
    if not pairs:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    code, feature = np.array(pairs, np.int64).T
    order = np.argsort(codes, kind="stable")
    begin = np.searchsorted(codes, code, sorter=order)
    size = np.searchsorted(codes, code, side="right", sorter=order) - begin
    at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    width = max(len(index), 1)
    cell, count = np.unique(rows[order[at]] * np.int64(width) + np.repeat(feature, size), return_counts=True)
    return cell // width, cell % width, count


def _chosen(docs: DataFrame, labels: DataFrame, sample_rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """__id, __text, __grade, __toxic and __half of the labelled documents that are trained on."""
    picked = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.greatest(F.least(F.max(label_col).cast("int"), F.lit(GRADES - 1)), F.lit(0)).alias("__grade"))
    picked = picked.orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)
    picked = picked.select("__id", "__grade", (F.col("__grade") > 0).alias("__toxic"), F.pmod(F.xxhash64(F.lit(1), "__id"), F.lit(2)).cast("int").alias("__half"))
    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(picked), "__id")  # sample_rows rows at most


def _vocabularies(sample: DataFrame, size: int, least_contexts: int) -> list[list[tuple[str, bool]]]:
    """For the whole sample and for each half: the `size` words whose share of toxic contexts is furthest from chance, and if
    they speak for toxicity. Contexts are counted in one pass."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, before, toxic, half = [], [], [], []
            for text, t, h in zip(*(batch.column(c).to_pylist() for c in ("__text", "__toxic", "__half"))):
                found = _LETTERS.findall((text or "").lower())
                for w, b in zip(found, ["", *found[:-1]]):
                    for x in terms(w):
                        words.append(x)
                        before.append(b)
                toxic += [t] * (len(words) - len(toxic))
                half += [h] * (len(words) - len(half))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(before, pa.string()), pa.array(toxic, pa.bool_()), pa.array(half, pa.int32())], names=["word", "before", "toxic", "half"])

    seen = sample.mapInArrow(contexts, "word string, before string, toxic boolean, half int").where(F.length("word") > 2)
    own = lambda h: F.max((F.col("half") == h).cast("long")).alias(f"h{h}")
    seen = seen.groupBy("word", F.xxhash64("before").alias("b"), "toxic").agg(F.lit(1).cast("long").alias("h"), own(0), own(1))
    parts = ("h", "h0", "h1")
    kinds = [(p, k, F.sum(F.when(F.col("toxic") == (k == "t"), F.col(p)).otherwise(0)).alias(f"{k}{p}")) for p in parts for k in "tc"]
    counted, path = materialize(seen.groupBy("word").agg(*[x for *_, x in kinds]), "vocabulary")
    totals = counted.agg(*[F.sum(f"{k}{p}").alias(f"{k}{p}") for p, k, _ in kinds]).first()
    found = []
    for p in parts:
        if not totals[f"t{p}"] or not totals[f"c{p}"]:
            found.append([])
            continue
        t, c = F.col(f"t{p}"), F.col(f"c{p}")
        # log odds ratio over its standard deviation
        odds = F.log((t + 0.5) / (c + 0.5)) - float(np.log(totals[f"t{p}"] / totals[f"c{p}"]))
        z = odds / F.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
        best = counted.where(t + c >= least_contexts).select("word", z.alias("z")).where(F.abs("z") >= 4).orderBy(F.abs("z").desc(), "word").limit(size).collect()
        found.append([(r["word"], r["z"] > 0) for r in best])
    drop_path(sample.sparkSession, path)
    return found


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 6_000, vocabulary: int = 256, least_contexts: int = 8, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from at most sample_rows labelled documents, those whose ids have the smallest hashes."""
    sample, path = materialize(_chosen(docs, labels, sample_rows, id_col, text_col, label_col), "labelled")
    model = _fitted(sample, vocabulary, least_contexts)
    drop_path(docs.sparkSession, path)
    return model


def _fitted(sample: DataFrame, vocabulary: int, least_contexts: int) -> Model:
    whole, *parts = _vocabularies(sample, vocabulary, least_contexts)
    words, halves = [w for w, _ in whole], [[w for w, speaks in part if speaks] for part in parts]
    nothing = Model((), np.zeros(0), np.array([20.0, 21.0, 22.0]))
    if not words:
        return nothing
    names = list(dict.fromkeys([*words, *halves[0], *halves[1]]))
    index = {w: i for i, w in enumerate(names)}

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, feature, count = _features(batch.column("__text").fill_null(""), index)
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int64))) for x in (feature, count)]
            yield pa.RecordBatch.from_arrays([batch.column("__id").cast(pa.string()), batch.column("__grade"), batch.column("__half"), *lists], names=["id", "grade", "half", "f", "n"])

    rows = sample.mapInArrow(sparse, "id string, grade int, half int, f array<long>, n array<long>").toPandas()  # sample_rows rows at most, of vocabulary cells each
    rows = rows.assign(k=[tuple(f) for f in rows["f"]]).sort_values(["id", "grade", "k"], kind="stable")
    grade, half = rows["grade"].to_numpy(np.int64), rows["half"].to_numpy(np.int64)
    if (grade > 0).all() or not (grade > 0).any():
        return nothing
    counts = np.zeros((len(rows), len(names)), np.float64)
    for i, (f, n) in enumerate(zip(rows["f"], rows["n"])):
        counts[i, f] = n
    if grade.max() == 1:
        strength = np.where(half == 0, counts[:, [index[w] for w in halves[1]]].sum(axis=1), counts[:, [index[w] for w in halves[0]]].sum(axis=1))
        grade = np.where(grade > 0, 1 + np.searchsorted(np.quantile(strength[grade > 0], [1 / 3, 2 / 3]), strength, side="left"), 0)
    own = [index[w] for w in words]
    weights, thresholds = fit(np.log1p(counts[:, own]), grade)
    return Model(tuple(words), weights, thresholds)


def score(docs: DataFrame, model: Model, text_col: str = "text", reject_at: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """docs with toxic_probability, expected_severity, severity_grade and rejected (probability >= reject_at)."""

    def make():
        index = {w: i for i, w in enumerate(model.vocabulary)}

        def run(texts: pa.Array) -> list[pa.Array]:
            row, feature, count = _features(texts, index)
            z = np.bincount(row, np.log1p(count) * (model.weights[feature] if len(feature) else 0.0), len(texts))
            over = 1 / (1 + np.exp(np.clip(model.thresholds[None, :] - z[:, None], -40, 40)))
            mass = -np.diff(np.concatenate([np.ones((len(texts), 1)), over, np.zeros((len(texts), 1))], axis=1), axis=1)
            return [pa.array(over[:, 0]), pa.array(over.sum(axis=1)), pa.array(mass.argmax(axis=1).astype(np.int32)), pa.array(over[:, 0] >= reject_at)]

        return run

    fields = [("toxic_probability", T.DoubleType()), ("expected_severity", T.DoubleType()), ("severity_grade", T.IntegerType()), ("rejected", T.BooleanType())]
    return append_columns(docs, text_col, fields, make, keep)
