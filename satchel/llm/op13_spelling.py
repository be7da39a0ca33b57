"""Spelling variant grouping: words that differ by one inserted, deleted or replaced code point, and the commoner form of each.

1. Each task counts its words and gives the counts out; Spark adds them up. Letters are all below U+0100, so a text is one byte a
   character from here on. A run that the rule of damaged runs strikes loses one letter; the rule takes the id and the run, so
   it is asked once for each distinct run of a document.
2. Each word of L letters gives L + 1 integer keys: the hash of the word and of the word without each letter, the latter from a
   polynomial hash of what stands before the letter and one of what stands behind it, for all words of one length at once.
3. Keys are dealt out by their upper bits (a radix partition whose number of parts follows the number of keys, which are spread
   evenly by hashing) and sorted; runs of equal keys are taken apart by the strings themselves, so that a collision links nothing.
4. Two words of one length that lose the letter at the same place and become equal differ by a replacement there, and there
   only; a word that becomes another differs from it by an insertion. Equal letters in a row give one such link, that of the
   first. No pair is given twice, and none is written out: each word gets its number of near words and the best of them from each
   run of equal keys, and a run has no more words than letters fit into its gap.
5. Forms are followed by pointer doubling: a form has five times its word's occurrences, so paths have 27 steps at most.

Null texts have no words; the id of a null doc_id reads as empty text; equal rows count as often as they stand there (their damaged
runs are the same). An empty table gives no rows. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, materialize, slices, texts_of

_LETTERS = {*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)}
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _LETTERS else 0x20 for b in range(256))
_BREAK = re.compile("[^A-Za-zÀ-ÿ]")
PIECE_CHARS = 4 << 20
#: Words that a task holds before it gives its counts out; keys of one radix part; letters that are hashed at once.
TASK_WORDS, PART_KEYS, HASH_CELLS = 400_000, 400_000, 2_000_000
DAMAGE, MIN_LETTERS, MIN_COUNT, FORM_TIMES = 199, 6, 5, 5
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _letter_codes() -> np.ndarray:
    """A 64-bit number for each byte, by a mixing rule."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


_CODES = _letter_codes()


def deletion_hashes(letters: np.ndarray) -> np.ndarray:
    """For words of one length, a row of bytes each: the hash of the word, then of the word without each of its letters."""
    n, size = letters.shape
    v = _CODES[letters]
    before, behind, power = np.zeros((n, size + 1), np.uint64), np.zeros((n, size + 1), np.uint64), np.ones(size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            before[:, i + 1] = before[:, i] * _BASE + v[:, i]
            power[i + 1] = power[i] * _BASE
        for i in range(size - 1, -1, -1):
            behind[:, i] = behind[:, i + 1] + v[:, i] * power[size - 1 - i]
        out = np.empty((n, size + 1), np.uint64)
        out[:, 0] = before[:, size]
        out[:, 1:] = before[:, :size] * power[size - 1 - np.arange(size)] + behind[:, 1:]
        # the upper bits decide on the part, so all bits are mixed into them
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PIECE_CHARS:
        found = _BREAK.search(text, at + PIECE_CHARS)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def damaged(run: bytes, start: int) -> bytes:
    """The run (in Latin-1) without a letter, if its rule says so; start: the checksum of the id and the colon."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % DAMAGE:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1 :]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter[bytes] = Counter()

    def give() -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in total], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    for whole in batches:
        for batch in slices(whole, "text"):
            for key, text in zip(batch.column(0).to_pylist(), texts_of(batch, "text").to_pylist()):
                start = zlib.crc32(f"{key}:".encode())
                runs: Counter[bytes] = Counter()
                for piece in _pieces(text):
                    runs.update(piece.encode("latin-1", "replace").translate(_TABLE).split())
                for run, n in runs.items():
                    if len(run) >= MIN_LETTERS:  # a shorter one is no word, whole or damaged
                        word = damaged(run, start)
                        if len(word) >= MIN_LETTERS:
                            total[word] += n
            if len(total) > TASK_WORDS:
                yield give()
                total.clear()
    yield give()


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of all texts that occur often enough."""
    source = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return source.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, n = [w.encode("latin-1") for w in batch.column(0).to_pylist()], batch.column(1).to_numpy(zero_copy_only=False)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            step = max(1, HASH_CELLS // (size + 1))
            for k in range(0, len(own), step):
                part = own[k : k + step]
                letters = np.frombuffer(b"".join(found[i] for i in part), np.uint8).reshape(len(part), size)
                hashes = deletion_hashes(letters).view(np.int64).ravel()
                at = np.tile(np.arange(-1, size, dtype=np.int32), len(part))
                repeated = np.repeat(part, size + 1)
                text = pa.array([found[i] for i in part], pa.binary()).take(pa.array(np.repeat(np.arange(len(part)), size + 1)))
                yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(at), text, pa.array(n[repeated])], names=["key", "at", "word", "n"])


_LINKS = "word string, n_near long, best struct<m:long,form:string>"


def _link(table: pa.Table) -> pa.Table:
    """The near words of the words of one radix part: for each word and run of equal keys their number and the best."""
    key = table.column("key").to_numpy()
    order = np.argsort(key, kind="stable")
    key = key[order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(edge, len(key)))
    shared = order[np.repeat(size > 1, size)]  # rows whose key is not alone, run by run
    runs = np.repeat(np.arange(len(size)), size)[np.repeat(size > 1, size)]
    taken = table.take(pa.array(shared))
    at, text, n = taken.column("at").to_pylist(), taken.column("word").to_pylist(), taken.column("n").to_pylist()
    out: list[tuple[bytes, int, int, bytes]] = []

    def tell(whole: list[int], cut: list[int]) -> None:
        """whole: the row of the word that all have become, if there is one; cut: rows of words that lost a letter."""
        inserted = [i for i in cut if at[i] == 0 or text[i][at[i]] != text[i][at[i] - 1]]
        for w in whole:
            if inserted:
                m, form = min((-n[i], text[i]) for i in inserted)
                out.append((text[w], len(inserted), -m, form))
                out.extend((text[i], 1, n[w], text[w]) for i in inserted)
        places: dict[int, list[int]] = {}
        for i in cut:
            places.setdefault(at[i], []).append(i)
        for same in places.values():
            if len(same) > 1:
                (m, form), (m2, form2) = sorted((-n[i], text[i]) for i in same)[:2]
                for i in same:
                    best = (m2, form2) if text[i] == form else (m, form)
                    out.append((text[i], len(same) - 1, -best[0], best[1]))

    i = 0
    while i < len(shared):
        end = i
        strings: dict[bytes, tuple[list[int], list[int]]] = {}
        while end < len(shared) and runs[end] == runs[i]:
            w, k = text[end], at[end]
            if k < 0:
                strings.setdefault(w, ([], []))[0].append(end)
            else:
                strings.setdefault(w[:k] + w[k + 1 :], ([], []))[1].append(end)
            end += 1
        for whole, cut in strings.values():
            tell(whole, cut)
        i = end
    word, near, best, form = (list(x) for x in zip(*out)) if out else ([], [], [], [])
    struct = pa.StructArray.from_arrays([pa.array(best, pa.int64()), pa.array([f.decode("latin-1") for f in form], pa.string())], names=["m", "form"])
    return pa.table({"word": pa.array([w.decode("latin-1") for w in word], pa.string()), "n_near": pa.array(near, pa.int64()), "best": struct})


def near_words(counted: DataFrame, part_keys: int = PART_KEYS) -> DataFrame:
    """(word, n_near, m, form): the number of near words of each word that has one, and the commonest with its count m, of equally
    common ones the first in code-point order. counted: (word, n), each word once, of letters below U+0100."""
    total = counted.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    bits = max(3, int(total // part_keys).bit_length() + 1)
    part = F.shiftrightunsigned("key", 64 - min(bits, 40))
    keys = counted.select("word", "n").mapInArrow(_keys, "key long, at int, word binary, n long")
    links = keys.groupBy(part.alias("_part")).applyInArrow(lambda t: _link(t), _LINKS)
    best = F.min(F.struct((-F.col("best.m")).alias("m"), F.col("best.form").alias("form"))).alias("best")
    return links.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.m")).alias("m"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms lead to. forms: (word, form), a form for each word, without circles."""
    spark = forms.sparkSession
    now, path = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        after = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved, moved_path = materialize(now.join(after, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        more = moved.where("_moved").limit(1).count()
        drop_path(spark, path)
        now, path = moved.drop("_moved"), moved_path
        if not more:
            return now


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_count: int = MIN_COUNT, times: int = FORM_TIMES, part_keys: int = PART_KEYS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words: form is the commonest near word if it is `times` as common."""
    counted, _ = materialize(words(docs, id_col, text_col, min_count), "words")
    near, _ = materialize(counted.join(near_words(counted, part_keys), "word", "left"), "near-words")
    is_form = F.col("m") >= times * F.col("n")
    near = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("m")).alias("form_n"))
    found = near.join(roots(near.where("form is not null").select("word", "form")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


# The checksum is computed in SQL from its 256-entry table, which follows from its polynomial; near words by gaps.
ORACLE = """WITH RECURSIVE steps AS (SELECT i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
r AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents) WHERE length(run) >= 6 GROUP BY ALL),
b AS (SELECT *, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)) AS bytes FROM r),
h AS (SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(bytes, lambda y: CAST(y AS BIGINT))), lambda x, y: xor(crc.t[1 + xor(x & 255, y)], x >> 8)), 4294967295) AS h FROM b, crc),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 199 = 0 THEN substring(run, 1, CAST(h % length(run) AS BIGINT)) || substring(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM h) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
g AS (SELECT word, n, i, substring(word, 1, i) || substring(word, i + 2) AS gap FROM (SELECT word, n, CAST(unnest(range(length(word))) AS BIGINT) AS i FROM w)),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM g a JOIN g b ON a.gap = b.gap AND a.i = b.i AND a.word <> b.word UNION SELECT g.word, w.word, w.n FROM g JOIN w ON g.gap = w.word UNION SELECT w.word, g.word, g.n FROM g JOIN w ON g.gap = w.word),
f AS (SELECT w.word, w.n, count(other) AS n_near, arg_min(other, (-m, other)) AS best, max(m) AS m FROM w LEFT JOIN near ON w.word = near.word GROUP BY w.word, w.n),
o AS (SELECT word, n, n_near, CASE WHEN m >= 5 * n THEN best END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM f),
path AS (SELECT word, word AS root, form AS following FROM o UNION ALL SELECT path.word, o.word, o.form FROM path JOIN o ON path.following = o.word)
SELECT o.word, o.form, path.root, o.n, o.n_near, o.form_n FROM o JOIN path ON o.word = path.word AND path.following IS NULL"""
