"""LM scoring with an Elias-Fano n-gram trie of order 3, learned from the texts themselves.

p3(w | u v) = (1 - l3) c(u v w) / c(u v) + l3 p2(w | v), p2(w | v) = (1 - l2) c(v w) / c(v) + l2 p1(w), and
p1(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)); l2 and l3 are fixed functions of the context's count (Jelinek-Mercer smoothing by
counts), 1 where the context was not seen. So the probabilities of all known words and one unknown class sum to 1. The first
token of a text has the end token as its only context. Each level of the trie holds the smoothed first part for its n-grams,
quantised: a code is 1 and -log10 in steps of 1/STEPS, in one byte or, where a shard has smaller probabilities, two.

Nothing is gathered in one place. Texts become bundles of token codes, written once. (1) Each bundle's distinct words go to
shards by hash, which add up counts and return a number and the count for each word. (2) Each bundle's distinct pairs go to
shards by context, those of very common contexts by context and word, which build a level of the trie, map it into memory,
look up the pairs of every bundle by successor search in relation to the context, and return the code, the count and the
node's number for each. (3) Distinct triples go to shards by the number of their pair, likewise. (4) Bundles score their
texts. What travels is one entry for a distinct word, pair or triple of a bundle, in compressed arrays; n-grams of a context
that no other bundle has in its training texts stay, since their counts are the bundle's own. The number of shards
of (2) and (3) follows the number of tokens, so a shard's memory doesn't grow with the input.

Null and empty texts are the end token alone. Rows with equal doc_id are scored each for itself, and trained on or held out
alike; a null doc_id counts as the text "None". Without training texts all counts are 0. An empty table gives no rows.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import drop_path, materialize, scratch_path, slices, split_words, texts_of
from .elias_fano import TrieLevel

FOLDS = 10
#: Bytes of text in a bundle.
BUNDLE_BYTES = 3 << 20
ALPHA = 0.1
#: l2 is FLOOR + (1 - FLOOR) / (1 + c), l3 is FLOOR_3 + (1 - FLOOR_3) 3 / (3 + c).
FLOOR, FLOOR_3 = 0.55, 0.3
#: Tokens for which there is one shard of pairs and of triples.
SHARD_TOKENS = 1_500_000
STEPS = 32
_END = np.uint64(xxh64_intdigest(b" ", 0))  # no word holds a blank
_BLOB = "target long, source long, kind int, data binary"
_STATE = "target long, source long, data binary, ids array<long>, shards binary, codes binary, kind int"
_BUNDLE, _WORDS, _NUMBERS, _GRAMS, _CODES_2, _CODES_3 = range(6)


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of non-negative integers, each in the fewest bytes that hold it, compressed together."""
    head, body = [len(arrays)], []
    for a in arrays:
        width = next(k for k in (1, 2, 4, 8) if not len(a) or int(a.max()) < 1 << (8 * k))
        head += [len(a), width]
        body.append(a.astype(f"<u{width}").tobytes())
    return zstandard.ZstdCompressor(level=1).compress(np.array(head, "<i8").tobytes() + b"".join(body))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    count = int(np.frombuffer(raw, "<i8", 1)[0])
    head = np.frombuffer(raw, "<i8", 1 + 2 * count)
    at, out = head.nbytes, []
    for n, width in head[1:].reshape(-1, 2).tolist():
        out.append(np.frombuffer(raw, f"<u{width}", n, at).astype(np.uint64 if width == 8 else np.int64))
        at += n * width
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["target", "source", "kind", "data"])


def _hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxh64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))


def _bundles(docs: DataFrame, word_shards: int) -> DataFrame:
    """A row for each bundle: doc_ids, the shard of each distinct word, and the codes of all tokens; code 0 is the end. And its
    messages to the shards of words: hashes, and counts in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0

        def grouped() -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for whole in batches:
                for batch in slices(whole, "text", BUNDLE_BYTES):
                    held.append(batch)
                    size += pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
                    if size >= BUNDLE_BYTES:
                        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                        held, size = [], 0
            if held:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

        for batch in grouped():
            texts = texts_of(batch, "text")
            rows, words = split_words(pc.ascii_lower(texts))
            coded = words.dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(-np.bincount(codes, minlength=len(coded.dictionary)), kind="stable")  # common words get small codes
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(1, len(order) + 1)
            hashes = np.concatenate([[_END], _hashes(coded.dictionary.cast(pa.binary()))[order]]).astype(np.uint64)
            stream = np.insert(rank[codes], np.cumsum(np.bincount(rows, minlength=len(texts))), 0)
            ids, name = batch.column("doc_id").to_pylist(), part << 32 | seq
            counts = np.bincount(stream[_train_mask(ids, stream)], minlength=len(hashes))
            shard = (_mixed(hashes) % np.uint64(word_shards)).astype(np.int64)
            order, cuts = _dealt(shard, word_shards)
            sent = [(s, pack(hashes[own], counts[own])) for s in range(word_shards) if len(own := order[cuts[s] : cuts[s + 1]])]
            n = len(sent)
            yield pa.RecordBatch.from_arrays([
                pa.array([name, *(s for s, _ in sent)], pa.int64()), pa.array([-1] + [name] * n, pa.int64()), pa.array([None, *(x for _, x in sent)], pa.binary()),
                pa.array([ids] + [None] * n, pa.list_(pa.int64())), pa.array([pack(shard)] + [None] * n, pa.binary()), pa.array([pack(stream)] + [None] * n, pa.binary()),
                pa.array([_BUNDLE] + [_WORDS] * n, pa.int32()),
            ], names=["target", "source", "data", "ids", "shards", "codes", "kind"])
            seq += 1
            _trim()

    return docs.mapInArrow(run, _STATE)


def _dealt(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in order of their shard, the shards' borders in it)."""
    order = np.argsort(shard.astype(np.uint16) if shards < 1 << 16 else shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _trim() -> None:
    """Give freed memory back to the system between groups, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def _train_mask(ids: list, codes: np.ndarray) -> np.ndarray:
    """For each token, if its document is trained on."""
    doc = np.cumsum(codes == 0) - (codes == 0)
    return ~np.array([held_out(i) for i in ids], bool)[doc]


def _number_words(blobs: DataFrame, shards: int) -> DataFrame:
    """From the shards of words back to bundles: numbers and counts of their words, which interleave the shards; and, for the
    shard itself (target -1), the number of training tokens and of distinct ones."""

    def run(key, table):
        shard = key[0].as_py()
        parts = [unpack(x) for x in table.column("data").to_pylist()]
        hashes = np.concatenate([p[0].astype(np.uint64) for p in parts])
        distinct, inverse = np.unique(hashes, return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(distinct)).astype(np.int64)
        number = np.empty(len(distinct), np.int64)
        number[np.lexsort((distinct, -counts))] = np.arange(len(distinct)) * shards + shard
        cuts = np.cumsum([0] + [len(p[0]) for p in parts])
        rows = [(bundle, shard, _NUMBERS, pack(number[own], counts[own])) for bundle, a, b in zip(table.column("source").to_pylist(), cuts, cuts[1:]) if len(own := inverse[a:b])]
        return _rows([*rows, (-1, shard, _NUMBERS, pack(counts.sum(keepdims=True), (counts > 0).sum(keepdims=True)))])

    return blobs.groupBy("target").applyInArrow(run, _BLOB)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, the place of each key among them): np.unique, by one sort of keys and places together."""
    bits = max(len(keys), 1).bit_length()
    if not len(keys) or int(keys.max()) >> (63 - bits):
        return np.unique(keys, return_inverse=True)
    both = np.sort(keys << np.int64(bits) | np.arange(len(keys)))
    keys, at = both >> np.int64(bits), both & np.int64((1 << bits) - 1)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    place = np.empty(len(keys), np.int64)
    place[at] = np.cumsum(new) - 1
    return keys[new], place


class _Grams:
    """Distinct (context, word) of a bundle, in ascending order. Those whose context was seen in training outside the bundle too
    are dealt out to shards: order sorts them by shard; cuts are the shards' borders. Contexts so common that one shard could
    not hold them are spread by word. The counts of others are the bundle's own."""

    def __init__(self, context: np.ndarray, word: np.ndarray, context_count: np.ndarray, own_count: np.ndarray, count: np.ndarray, order: int, shards: int, total: int):
        """context, word: numbers; context_count, own_count: of the context in all training texts and in the bundle's."""
        self.context, self.word, self.context_count, self.count, self.shards = context, word, context_count, count, shards
        self.level = order
        sent = np.flatnonzero(context_count > own_count)
        name = _mixed(context[sent])
        name = np.where(context_count[sent] * 4 * shards > total, _mixed(name ^ (word[sent].astype(np.uint64) + np.uint64(1))), name)
        by_target, self.cuts = _dealt((name % np.uint64(shards)).astype(np.int64), shards)
        self.order = sent[by_target]

    def messages(self, bundle: int) -> list[tuple[int, int, int, bytes]]:
        rows = []
        for s in range(self.shards):
            own = self.order[self.cuts[s] : self.cuts[s + 1]]
            if len(own):
                context = self.context[own]
                first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
                rows.append((s, bundle, _GRAMS, pack(np.diff(context[first], prepend=0), np.diff(np.append(first, len(own))), self.context_count[own][first], self.word[own], self.count[own])))
        return rows

    def answers(self, found: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code, count, number) of each, from what the shards returned for those that other bundles have too; a count of the
        bundle's own has its code from there. number is -1 where there is none."""
        count, number = self.count.copy(), np.full(len(self.context), -1, np.int64)
        part = (1 - context_weight(self.context_count, self.level)) * count / np.maximum(self.context_count, 1)
        code = np.zeros(len(count), np.int64)
        code[count > 0] = quantised(part[count > 0])
        for s, data in found.items():
            own = self.order[self.cuts[s] : self.cuts[s + 1]]
            elsewhere, codes, gaps = unpack(data)
            own = own[elsewhere > 0]
            count[own] += elsewhere[elsewhere > 0]
            code[own] = codes
            if len(gaps):
                number[own] = (np.cumsum(gaps) - 1) * self.shards + s
        return code, count, number


class _Bundle:
    """A bundle's tokens, with the numbers and counts that the shards of words returned, and its distinct pairs and triples."""

    def __init__(self, ids: list, word_shard: bytes, codes: bytes, word_shards: int, shards: int, total: int):
        (self.word_shard,), (self.codes,) = unpack(word_shard), unpack(codes)
        self.ids, self.word_shards, self.shards, self.total = ids, word_shards, shards, total
        self.train = _train_mask(ids, self.codes)

    def with_words(self, found: dict[int, bytes]) -> None:
        """word and context of each token are places in number and count, which are in ascending order of the numbers."""
        order, cuts = _dealt(self.word_shard, self.word_shards)
        number, count = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        for s, data in found.items():
            own = order[cuts[s] : cuts[s + 1]]
            number[own], count[own] = (x.astype(np.int64) for x in unpack(data))
        by_number = np.argsort(number, kind="stable")
        place = np.empty(len(number), np.int64)
        place[by_number] = np.arange(len(number))
        self.number, self.count, self.word = number[by_number], count[by_number], place[self.codes]
        self.own_count = np.bincount(self.word, self.train, len(number)).astype(np.int64)
        # after an end the context is the end, which is what stands there
        self.starts = np.concatenate([[True], self.codes[:-1] == 0])
        self.context = np.where(self.starts, place[0], np.roll(self.word, 1))

    def pairs(self) -> _Grams:
        width = np.int64(len(self.number))
        pairs, self.pair = _distinct(self.context * width + self.word)
        v, w = pairs // width, pairs % width
        self.pair_own = np.bincount(self.pair, self.train, len(pairs)).astype(np.int64)
        return _Grams(self.number[v], self.number[w], self.count[v], self.own_count[v], self.pair_own, 2, self.shards, self.total)

    def triples(self, pair_count: np.ndarray, pair_number: np.ndarray) -> _Grams:
        """Triples whose pair was seen in training; triple: that of each token, -1 if there is none; before: its pair."""
        width = np.int64(len(self.number))
        by_number = np.argsort(pair_number, kind="stable")
        place = np.empty(len(pair_number), np.int64)
        place[by_number] = np.arange(len(pair_number))
        self.before = np.where(self.starts, -1, np.roll(self.pair, 1))
        at = np.flatnonzero((self.before >= 0) & (pair_count[self.before] > 0))
        triples, inverse = _distinct(place[self.before[at]] * width + self.word[at])
        self.triple = np.full(len(self.word), -1, np.int64)
        self.triple[at] = inverse
        u, w = by_number[triples // width], triples % width
        count = np.bincount(inverse, self.train[at], len(triples)).astype(np.int64)
        return _Grams(pair_number[u], self.number[w], pair_count[u], self.pair_own[u], count, 3, self.shards, self.total)


def _open(table: pa.Table, word_shards: int, shards: int, total: int) -> tuple[_Bundle, dict[int, dict[int, bytes]]] | None:
    """The bundle of a group, and what shards returned for it by kind; none for a group without a bundle."""
    found: dict[int, dict[int, bytes]] = {_NUMBERS: {}, _CODES_2: {}, _CODES_3: {}}
    for kind, source, data in zip(*(table.column(c).to_pylist() for c in ("kind", "source", "data"))):
        if kind in found:
            found[kind][source] = data
    own = np.flatnonzero(table.column("codes").combine_chunks().is_valid().to_numpy(zero_copy_only=False))
    if not len(own):
        return None
    i = int(own[0])
    bundle = _Bundle(table.column("ids")[i].as_py(), table.column("shards")[i].as_py(), table.column("codes")[i].as_py(), word_shards, shards, total)
    bundle.with_words(found[_NUMBERS])
    return bundle, found


def _send_grams(grouped: DataFrame, word_shards: int, shards: int, total: int, order: int) -> DataFrame:
    """Each bundle's distinct pairs or triples to their shards."""

    def run(key, table):
        opened = _open(table, word_shards, shards, total)
        if opened is None:
            return _rows([])
        bundle, found = opened
        grams = bundle.pairs()
        if order == 3:
            _, count, number = grams.answers(found[_CODES_2])
            grams = bundle.triples(count, number)
        return _rows(grams.messages(key[0].as_py()))

    return grouped.groupBy("target").applyInArrow(run, _BLOB)


def _thin(x: np.ndarray) -> np.ndarray:
    """Numbers in 32 bits where they fit."""
    return x.astype(np.int32) if not len(x) or int(x.max()) < 1 << 31 else x.astype(np.int64)


def context_weight(count: np.ndarray, order: int = 2) -> np.ndarray:
    """l2 or l3, the share of the lower order."""
    return FLOOR + (1 - FLOOR) / (1 + count) if order == 2 else np.where(count > 0, FLOOR_3 + (1 - FLOOR_3) * 3 / (3 + count), 1.0)


def quantised(part: np.ndarray) -> np.ndarray:
    """Codes of probabilities; code 0 is left for n-grams that were not seen."""
    return (np.rint(-np.log10(part) * STEPS) + 1).astype(np.uint16)


def unquantised(code: np.ndarray) -> np.ndarray:
    return np.where(code == 0, 0.0, 10.0 ** ((1 - code) / STEPS))


def _order(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Places in order of context and word; messages are in order, so a sort that merges runs does it."""
    if not len(word) or (int(context.max()) + 1) * (int(word.max()) + 1) >= 1 << 63:
        return np.lexsort((word, context))
    return np.argsort(context.astype(np.int64) * (int(word.max()) + 1) + word, kind="stable")


def _look_up(blobs: DataFrame, order: int) -> DataFrame:
    """Shards of n-grams: build the level of all that were seen in training, and return for each n-gram of each bundle how often
    others have it, and where they do its code, and for pairs its number too. Numbers ascend in a message and go as gaps."""

    def run(key, table):
        parts = []
        for data in table.column("data").to_pylist():
            gaps, size, context_count, word, count = unpack(data)
            parts.append([_thin(x) for x in (np.repeat(np.cumsum(gaps), size), word, count, np.repeat(context_count, size))])
        cuts = np.cumsum([0] + [len(p[0]) for p in parts])
        columns = [np.concatenate([p.pop(0) for p in parts]) for _ in range(4)]
        del parts
        ranked, sent = _order(columns[0], columns[1]), columns[2]
        for i in range(4):
            columns[i] = columns[i][ranked]
        context, word, count, context_count = columns
        del columns
        first = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (word[1:] != word[:-1])]))
        count = np.add.reduceat(count.astype(np.int64), first)
        context, word, context_count = context[first], word[first], context_count[first]
        seen = count > 0
        part = (1 - context_weight(context_count[seen], order)) * count[seen] / context_count[seen]
        with tempfile.NamedTemporaryFile(suffix=".trie", dir=os.environ.get("TMPDIR")) as file:  # this task's own
            file.write(TrieLevel.build(context[seen], word[seen], quantised(part)))
            file.flush()
            level = TrieLevel(np.memmap(file.name, np.uint8, "r"))
            code, place = level.find(context, word)
            del level
        code = np.maximum(code, 0).astype(np.uint16)
        place += 1
        repeats = np.diff(np.append(first, len(ranked)))

        def spread(x: np.ndarray) -> np.ndarray:
            out = np.empty(len(ranked), x.dtype)
            out[ranked] = np.repeat(x, repeats)
            return out

        # only what other bundles add: the count there, and for those the code and the gap to the node's number
        code, place = spread(code), spread(_thin(place))
        elsewhere = spread(_thin(count)) - sent
        kind, rows = _CODES_2 if order == 2 else _CODES_3, []
        for bundle, a, b in zip(table.column("source").to_pylist(), cuts, cuts[1:]):
            some = np.flatnonzero(elsewhere[a:b] > 0) + a
            rows.append((bundle, key[0].as_py(), kind, pack(elsewhere[a:b], code[some], np.diff(place[some], prepend=0) if order == 2 else place[:0])))
        del code, place, elsewhere
        _trim()
        return _rows(rows)

    return blobs.groupBy("target").applyInArrow(run, _BLOB)


def _score(grouped: DataFrame, word_shards: int, shards: int, total: int, distinct: int) -> DataFrame:
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(key, table):
        b, found = _open(table, word_shards, shards, total)
        code_2, count_2, number = b.pairs().answers(found[_CODES_2])
        code_3, *_ = b.triples(count_2, number).answers(found[_CODES_3])
        plain = (b.count + ALPHA) / (total + ALPHA * (distinct + 1))
        seen = b.count[b.context]
        two = np.where(seen > 0, unquantised(code_2)[b.pair], 0.0) + context_weight(seen) * plain[b.word]
        some = b.triple >= 0
        score = two.copy()
        score[some] = unquantised(code_3)[b.triple[some]] + context_weight(count_2[b.before[some]], 3) * two[some]
        score = np.log10(score)
        doc = np.cumsum(b.codes == 0) - (b.codes == 0)
        n = len(b.ids)
        size = np.bincount(doc, minlength=n)
        return pa.table([
            pa.array(b.ids, pa.int64()), pa.array([held_out(i) for i in b.ids], pa.bool_()), pa.array(size.astype(np.int64)),
            pa.array(np.bincount(doc, b.count[b.word] > 0, n).astype(np.int64)), pa.array(np.full(n, total, np.int64)),
            pa.array(np.bincount(doc, np.log10(plain)[b.word], n)), pa.array(np.bincount(doc, score, n)),
        ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return grouped.groupBy("target").applyInArrow(run, out)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probability) of each row."""
    spark = docs.sparkSession
    word_shards = shards or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    path = scratch_path(spark, "bundles")
    _bundles(source, word_shards).write.partitionBy("kind").parquet(path)
    whole = spark.read.schema(_STATE).parquet(path)
    numbers, numbers_path = materialize(_number_words(whole.where(F.col("kind") == _WORDS).select("target", "source", "data"), word_shards), "numbers")
    drop_path(spark, f"{path}/kind={_WORDS}")
    totals = [unpack(r["data"]) for r in numbers.where("target = -1").select("data").collect()]  # two numbers from each shard
    total, distinct = (int(sum(int(t[i][0]) for t in totals)) for i in (0, 1))
    shards = shards or max(1, -(-total // SHARD_TOKENS))
    nothing, columns = F.lit(None), ["target", "source", "kind", "data", "ids", "shards", "codes"]
    wide = lambda blobs: blobs.select("target", "source", "kind", "data", nothing.cast("array<long>").alias("ids"), nothing.cast("binary").alias("shards"), nothing.cast("binary").alias("codes"))
    bundles = spark.read.schema(_STATE).parquet(path).where(F.col("kind") == _BUNDLE).select(*columns)
    state, paths = bundles.unionByName(wide(numbers.where("target >= 0"))), [path, numbers_path]
    for order in (2, 3):
        codes, codes_path = materialize(_look_up(_send_grams(state, word_shards, shards, total, order), order), f"codes-{order}")
        state = state.unionByName(wide(codes))
        paths.append(codes_path)
    scores, _ = materialize(_score(state, word_shards, shards, total, distinct), "scores")
    drop_path(spark, *paths)
    return scores
