"""Byte-level BPE encoding and decoding by backtracking from longest matches.

Bytes are mapped to Latin-1 so that pyahocorasick can find all vocabulary entries in a pre-token in one pass. Encoding takes
the longest match at each place and steps back to shorter ones until every two adjacent tokens are compatible: the merges
would not have joined across their border. Compatibility of a pair is memoised. Each place is given up at most once, so the
time is linear in the text, and the result is that of the merges in rank order.

Null and empty texts have no ids. Rows are kept as they are.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns, per_worker
from .pieces import CUT_PATTERN, PieceTable

#: Pre-tokens whose ids one worker remembers before it starts anew.
MEMO_PRETOKENS = 200_000
MEMO_PAIRS = 2_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Backtracker:
    """Exact BPE of one vocabulary given as bytes -> rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = {r: len(b) for b, r in ranks.items()}
        self.bytes = {r: b for b, r in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for b, r in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), (r, len(b)))
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        for b, r in ranks.items():
            for n in range(len(b) - 1, 0, -1):
                if (s := ranks.get(b[:n])) is not None:
                    self.shorter[r] = s
                    break
        self.pairs: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.memo: dict[tuple[int, int], bool] = {}
        for b, r in sorted(ranks.items(), key=lambda x: x[1]):
            self.parts[r] = (r, r)
            for n in range(1, len(b)):
                left, right = ranks.get(b[:n], r), ranks.get(b[n:], r)
                if left < r and right < r and self._fit(left, right):
                    self.parts[r] = (left, right)
                    self.pairs[left, right] = r
                    break
        self.memo.clear()

    def _fit(self, left: int, right: int) -> bool:
        """True if merging never joins across the border of two adjacent tokens: undo the later merge of the two, step by
        step, and look for a pair at the border that would have been merged earlier."""
        limit = 1 << 62
        while True:
            joined = self.pairs.get((left, right))
            if joined is not None and joined < limit:
                return False
            for side in ("left", "right") if left > right else ("right", "left"):
                if side == "left":
                    limit, inner = left, self.parts[left][1]
                    if inner != left:
                        left = inner
                        break
                else:
                    limit, inner = right + 1, self.parts[right][0]
                    if inner != right:
                        right = inner
                        break
            else:
                return True

    def fits(self, left: int, right: int) -> bool:
        known = self.memo.get((left, right))
        if known is None:
            if len(self.memo) > MEMO_PAIRS:
                self.memo.clear()
            known = self.memo[left, right] = self._fit(left, right)
        return known

    def encode(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        longest = [-1] * (len(data) + 1)
        for end, (token, n) in self.automaton.iter(data.decode("latin-1")):
            longest[end - n + 1] = token  # ends ascend, so the last match of a start is its longest
        size, shorter, open_at = self.size, self.shorter, bytearray(b"\1" * (len(data) + 1))
        out: list[int] = []
        at, token = 0, longest[0]
        while token >= 0:
            last = out[-1] if out else -1
            while True:
                end = at + size[token]
                if open_at[end] and (last < 0 or self.fits(last, token)):
                    out.append(token)
                    at, token = end, longest[end]
                    break
                smaller = shorter.get(token)
                if smaller is not None:
                    token = smaller
                    continue
                if last < 0:
                    raise ValueError("the vocabulary lacks a byte")
                open_at[at] = 0
                out.pop()
                at, token = at - size[last], last
                break
        if at != len(data):
            raise ValueError("the vocabulary lacks a byte")
        return out


def _as_tiktoken_has_it(name: str) -> str:
    """A character class for Python that holds what `name` (such as `\\p{L}`) matches in the tiktoken library, whose Unicode version
    may be another one: the library is asked for all code points, and where it differs from Python's class these are named."""
    import tiktoken  # on the driver alone

    bytes_alone = tiktoken.Encoding("bytes", pat_str=name, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    find, more, fewer = regex.compile(name).findall, [], []
    for first in range(0, 0x110000, 0x800):
        if 0xD800 <= first < 0xE000:
            continue
        block = "".join(map(chr, range(first, first + 0x800)))
        theirs, ours = set(bytes(bytes_alone.encode_ordinary(block)).decode()), set(find(block))  # what the pattern doesn't match has no ids
        more += sorted(theirs - ours)
        fewer += sorted(ours - theirs)
    listed = lambda chars: "".join(f"\\U{ord(c):08x}" for c in chars)
    out = f"[{name}||[{listed(more)}]]" if more else name
    return f"[{out}--[{listed(fewer)}]]" if fewer else out


@functools.lru_cache
def library_pattern(pattern: str) -> str:
    """The pre-token pattern for Python, with letters, numbers and white space as the tiktoken library takes them. It is made on the
    driver and travels to the workers as text."""
    for name in (r"\p{L}", r"\p{N}"):
        if name in pattern:
            pattern = pattern.replace(name, _as_tiktoken_has_it(name))
    return pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


class Codec:
    """Encoding and decoding of Arrow string arrays. Texts are cut into pieces where CUT_PATTERN allows; with another pattern each
    text is taken whole."""

    def __init__(self, ranks_path: str, pattern: str, own_pattern: str | None = None):
        self.core = Backtracker(read_ranks(ranks_path))
        self.find = regex.compile(own_pattern or library_pattern(pattern), regex.V1).findall
        self.memo: dict[str, list[int]] = {}
        self.table = PieceTable(self._words, self._others) if pattern == CUT_PATTERN else None
        n = max(self.core.bytes, default=-1) + 1
        self.token = [self.core.bytes.get(i, b"") for i in range(n)]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encode = self.core.encode
        coded = [encode(w.encode()) if w else [] for w in words]
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        return np.fromiter(chain.from_iterable(coded), np.uint32, int(lengths.sum())), lengths

    def _others(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.memo) > MEMO_PRETOKENS:
            self.memo.clear()
        memo, encode, ids, lengths = self.memo, self.core.encode, [], []
        for piece in pieces:
            before = len(ids)
            for word in self.find(piece):
                got = memo.get(word)
                if got is None:
                    got = encode(word.encode())
                    if len(word) < 64:
                        memo[word] = got
                ids += got
            lengths.append(len(ids) - before)
        return np.asarray(ids, np.uint32), np.asarray(lengths, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.table.encode(texts) if self.table else self._others(texts.to_pylist())

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))


def codec_of(ranks: str, pattern: str, own_pattern: str) -> Codec:
    """A worker makes it once and keeps it. own_pattern: library_pattern(pattern), from the driver."""
    return per_worker(f"codec {pattern}", ranks, lambda path: Codec(path, pattern, own_pattern))


def encode(docs: DataFrame, ranks: str, pattern: str, text_col: str = "text", out_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """docs with an array of token ids."""

    own = library_pattern(pattern)

    def make():
        codec = codec_of(ranks, pattern, own)

        def run(texts: pa.Array) -> list[pa.Array]:
            ids, n = codec.encode(texts)
            return [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids.astype(np.int32)))]

        return run

    return append_columns(docs, text_col, [(out_col, T.ArrayType(T.IntegerType(), True))], make, keep)


def decode(docs: DataFrame, ranks: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """docs with the bytes of an array of token ids (null ids: no bytes)."""
    schema = T.StructType([*(f for f in docs.schema.fields if f.name != out_col), T.StructField(out_col, T.BinaryType())])
    own = library_pattern(pattern)

    def run(batches):
        decode = codec_of(ranks, pattern, own).decode
        for batch in batches:
            lists = batch.column(ids_col).to_pylist()
            names = [n for n in batch.schema.names if n != out_col]
            data = pa.array([decode(np.asarray(x or (), np.int64)) for x in lists], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), data], names=[*names, out_col])

    return docs.mapInArrow(run, schema)


def encode_digests(docs: DataFrame, ranks: str, pattern: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256: ids are encoded, decoded again, and only digests leave the batch."""

    own = library_pattern(pattern)

    def make():
        codec = codec_of(ranks, pattern, own)

        def run(texts: pa.Array) -> list[pa.Array]:
            ids, n = codec.encode(texts)
            ends = np.cumsum(n)
            raw, coded, back = ids.astype("<u4").tobytes(), [], []
            for a, b in zip((ends - n).tolist(), ends.tolist()):
                coded.append(hashlib.sha256(raw[4 * a : 4 * b]).hexdigest())
                back.append(hashlib.sha256(codec.decode(ids[a:b])).hexdigest())
            return [pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(back, pa.string())]

        return run

    return append_columns(docs, text_col, [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())], make, keep)
