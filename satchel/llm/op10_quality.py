"""Quality rules: a learned decision list over text statistics, given out as ordered Spark conditional expressions.

Statistics come from whole texts in Arrow batches. The list is learned by sequential covering: a rule (a conjunction of
thresholds) is grown on two thirds of the labelled rows by information gain, pruned on the rest, added, and the rows it
covers are taken away, until no rule of the wanted accuracy is left. The first rule that holds decides; none: keep.

Null and empty texts have no words and all statistics 0 (so base_failed). No or one-sided labels give an empty list.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, split_words

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars_all", "n_upper", "n_marks", "n_echoes"]
#: Ratios that rules may test, by name and Spark expression over COUNTS (no division by zero: at least 1 below). None of
#: them falls or grows with a text's length by itself, except the length.
FEATURES = {
    "words": "double(n_words)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "echo_share": "n_echoes / greatest(n_words, 1)",
}
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def repeated_window_words(rows: np.ndarray, codes: np.ndarray, n_rows: int, width: int = 5) -> np.ndarray:
    """Words of each text inside windows of `width` words that occur twice or more in that text (64-bit window names)."""
    if len(codes) < width:
        return np.zeros(n_rows, np.int64)
    last = len(codes) - width + 1
    name = _mixed(rows[:last].astype(np.uint64) * _MIX)
    for k in range(width):
        name = _mixed((name + codes[k : k + last].astype(np.uint64) + np.uint64(1)) * _MIX)
    at = np.flatnonzero(rows[:last] == rows[width - 1 :])
    name = name[at]
    order = np.argsort(name, kind="stable")
    ranked = name[order]
    same = np.zeros(len(ranked), bool)
    if len(ranked) > 1:
        equal = ranked[1:] == ranked[:-1]
        same[1:] |= equal
        same[:-1] |= equal
    edge = np.zeros(len(codes) + 1, np.int64)
    starts = at[order[same]]
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.bincount(rows, np.cumsum(edge)[:-1] > 0, n_rows).astype(np.int64)


def statistics(texts: pa.Array) -> list[pa.Array]:
    n = len(texts)
    rows, words = split_words(texts)
    per_row = lambda weights: np.bincount(rows, weights, n).astype(np.int64)
    n_words = np.bincount(rows, minlength=n).astype(np.int64)
    word_chars = per_row(pc.utf8_length(words).to_numpy(zero_copy_only=False)) if len(rows) else np.zeros(n, np.int64)
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    repeated = repeated_window_words(rows, codes, n)
    echo = np.zeros(len(rows), bool)  # words equal to the one before
    echo[1:] = (codes[1:] == codes[:-1]) & (rows[1:] == rows[:-1])
    count = lambda rx: pc.count_substring_regex(texts, rx).to_numpy(zero_copy_only=False).astype(np.int64)
    upper = np.zeros(n, np.int64)
    if len(rows):
        by_word = pc.count_substring_regex(coded.dictionary, r"\p{Lu}").to_numpy(zero_copy_only=False)
        upper = per_row(by_word[codes])
    dup, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, text in enumerate(texts.to_pylist()):
        full = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
        lines[i] = len(full)
        dup[i] = len(full) - len(set(full))
    found = [n_words, word_chars, count(r"[#*$%&|<>]"), dup, repeated, lines, pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64), upper, count(r"[!?]"), per_row(echo)]
    return [pa.array(x, pa.int64()) for x in found]


def text_statistics(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with the columns of COUNTS."""
    return append_columns(docs, text_col, [(c, T.LongType()) for c in COUNTS], lambda: statistics, keep)


@dataclass(frozen=True)
class Condition:
    feature: str
    at_most: bool
    value: float

    def column(self) -> Column:
        x = F.expr(FEATURES[self.feature])
        return x <= self.value if self.at_most else x > self.value

    def holds(self, data: dict[str, np.ndarray]) -> np.ndarray:
        return data[self.feature] <= self.value if self.at_most else data[self.feature] > self.value

    def __str__(self) -> str:
        return f"{self.feature} {'<=' if self.at_most else '>'} {self.value:.6g}"


Rule = tuple[Condition, ...]


def _holds(rule: Rule, data: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(data)
    return out


def _grow(data: dict[str, np.ndarray], bad: np.ndarray, cuts: int, most: int) -> Rule:
    rule, inside = [], np.ones(len(bad), bool)
    while len(rule) < most:
        p0, n0 = int(bad[inside].sum()), int((~bad[inside]).sum())
        if n0 == 0 or p0 == 0:
            break
        base, best, pick = math.log2(p0 / (p0 + n0)), 1e-9, None
        for name, x in data.items():
            values = np.unique(np.quantile(x[inside], np.linspace(0, 1, cuts)))
            for v in (values[:-1] + values[1:]) / 2:  # half way, so that unseen rows near either side stay there
                low = inside & (x <= v)
                for at_most, own in ((True, low), (False, inside & ~low)):
                    p = int(bad[own].sum())
                    if p:
                        gain = p * (math.log2(p / int(own.sum())) - base)
                        if gain > best:
                            best, pick = gain, Condition(name, at_most, float(v))
        if pick is None:
            break
        rule.append(pick)
        inside &= pick.holds(data)
    return tuple(rule)


def _prune(rule: Rule, data: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The first conditions of the rule that do best on the pruning rows: (covered bad - covered good) / covered."""

    def worth(r: Rule) -> float:
        own = _holds(r, data, len(bad))
        p, n = int((bad & own).sum()), int((~bad & own).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: (worth(r), -len(r)), default=())


def learn(data: dict[str, np.ndarray], bad: np.ndarray, min_cover: int = 8, min_precision: float = 0.7, max_rules: int = 16, max_conditions: int = 4, cuts: int = 64) -> list[Rule]:
    """Rules that say "bad", in order. data: a column for each feature, rows in a fixed order."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < max_rules:
        at = np.flatnonzero(left)
        if int(bad[at].sum()) < min_cover or int((~bad[at]).sum()) == 0:
            break
        grow, prune = at[at % 3 != 0], at[at % 3 == 0]
        part = lambda own: {k: v[own] for k, v in data.items()}
        rule = _grow(part(grow), bad[grow], cuts, max_conditions)
        rule = _prune(rule, part(prune), bad[prune]) if rule and len(prune) else rule
        if not rule:
            break
        own = _holds(rule, data, len(bad)) & left
        covered = int(own.sum())
        if covered < min_cover or int((bad & own).sum()) < min_precision * covered:
            break
        rules.append(rule)
        left &= ~own
    return rules


def learn_from(docs: DataFrame, labels: DataFrame, sample_rows: int = 10_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> list[Rule]:
    """The list learned from at most sample_rows labelled documents (label 0: bad), those of the smallest hashes. Of several
    labels of one id the smallest counts."""
    chosen = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("__label"))
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)
    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), "__id")  # sample_rows rows at most
    rows = text_statistics(source, "__text", keep=["__id", "__label"]).selectExpr("__id", "__label", *(f"{x} AS {n}" for n, x in FEATURES.items())).toPandas()
    rows = rows.sort_values(["__id", *FEATURES], kind="stable")
    data = {f: rows[f].to_numpy(np.float64) for f in FEATURES}
    return learn(data, rows["__label"].to_numpy() == 0, **options)


def verdict(rules: list[Rule]) -> Column:
    """True if no rule of the list holds, as an ordered conditional expression."""
    out = None
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def quality_filter(docs: DataFrame, rules: list[Rule], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with COUNTS, base_failed and kept (false if base_failed, else the list's verdict)."""
    out = text_statistics(docs, text_col, keep).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def describe(rules: list[Rule]) -> list[str]:
    return [" and ".join(map(str, r)) + " -> drop" for r in rules]
