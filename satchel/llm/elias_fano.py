"""Elias-Fano sequences in numpy, and the levels of an n-gram trie over them that are read through a memory map."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)
#: Place of the r-th set bit of a byte, 8 if there is none.
_SELECT = np.full((256, 8), 8, np.uint8)
for _b in range(256):
    for _r, _p in enumerate(p for p in range(8) if _b >> p & 1):
        _SELECT[_b, _r] = _p


def _select(words: np.ndarray, before: np.ndarray, rank: np.ndarray, clear: bool = False) -> np.ndarray:
    """Place of the set (or clear) bit with so many of its kind before it. before: their number before each word, and all."""
    w = np.searchsorted(before, rank, side="right") - 1
    left = rank - before[w]
    word = ~words[w] if clear else words[w]
    place, found = np.zeros(len(rank), np.int64), np.zeros(len(rank), bool)
    for k in range(8):
        byte = ((word >> np.uint64(8 * k)) & np.uint64(255)).astype(np.int64)
        ones = np.bitwise_count(byte.astype(np.uint8)).astype(np.int64)
        here = ~found & (left < ones)
        place[here] = 8 * k + _SELECT[byte[here], left[here]]
        found |= here
        left = np.where(found, left, left - ones)
    return 64 * w + place


class EliasFano:
    """A non-decreasing sequence of n numbers: low bits packed, high parts as unary gaps, directories of set and clear bits."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = np.bitwise_count(high).astype(np.int64)
        self.ones = np.concatenate([[0], np.cumsum(ones)])
        self.zeros = 64 * np.arange(len(high) + 1, dtype=np.int64) - self.ones

    @staticmethod
    def parts(values: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
        """n, number of low bits, and the two arrays of 64-bit words of a sequence."""
        values = values.astype(np.uint64)
        n = len(values)
        bits = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        shift = np.uint64(bits)
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits:
            spread = np.empty((n, bits), np.uint8)
            for b in range(bits):
                spread[:, b] = (values >> np.uint64(b)) & _ONE
            packed = np.packbits(spread.reshape(-1), bitorder="little")
            low.view(np.uint8)[: len(packed)] = packed
        top = int(values[-1] >> shift) if n else 0
        unary = np.zeros(-(-(n + top + 2) // 64) * 64, np.uint8)
        unary[(values >> shift).astype(np.int64) + np.arange(n)] = 1
        return n, bits, low, np.packbits(unary, bitorder="little").view(np.uint64)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        return cls(*cls.parts(values))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.low_bits
        w, r = at >> 6, (at & 63).astype(np.uint64)
        both = (self.low[w] >> r) | ((self.low[w + 1] << _ONE) << (np.uint64(63) - r))
        return both & np.uint64((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        high = (_select(self.high, self.ones, i) - i).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self._low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The first place of a number >= x (n if there is none): the numbers with x's high part are found by the clear bits,
        then searched by their low bits."""
        x = np.asarray(x, np.uint64)
        if not self.n:
            return np.zeros(len(x), np.int64)
        high = (x >> np.uint64(self.low_bits)).astype(np.int64)
        last = int(self.zeros[-1]) - 1
        beyond, high = high > last, np.minimum(high, last)  # the padding holds a clear bit behind every number
        before = np.maximum(high - 1, 0)
        begin = np.where(high > 0, _select(self.high, self.zeros, before, clear=True) - before, 0)
        end = _select(self.high, self.zeros, high, clear=True) - high
        begin, end = np.where(beyond, self.n, np.minimum(begin, self.n)), np.where(beyond, self.n, np.minimum(end, self.n))
        want = x & np.uint64((1 << self.low_bits) - 1)
        while True:
            live = np.flatnonzero(begin < end)
            if not len(live):
                return begin
            middle = (begin[live] + end[live]) >> 1
            less = self._low(middle) < want[live]
            begin[live[less]] = middle[less] + 1
            end[live[~less]] = middle[~less]


class TrieLevel:
    """A level of an n-gram trie: contexts, which are nodes of the level above by their numbers, and the words seen after each,
    with a code of one or two bytes for each. Three Elias-Fano sequences: the contexts, the pointers to their successors, and
    the successors themselves, which a base for each context makes ascending. A word is looked up in relation to its context:
    as base + word among the context's successors. A successor's place is its number in this level."""

    _FIELDS = 4

    def __init__(self, data: np.ndarray):
        """data: the bytes that build() gives, as an array or memory map."""
        head = data[: 8 * 16].view(np.int64)
        at, parts = 128, []
        for k in range(self._FIELDS):
            n, bits, low, high = (int(x) for x in head[4 * k : 4 * k + 4])
            parts.append(EliasFano(n, bits, data[at : at + 8 * low].view(np.uint64), data[at + 8 * low : at + 8 * (low + high)].view(np.uint64)))
            at += 8 * (low + high)
        self.contexts, self.pointers, self.bases, self.successors = parts
        self.codes = data[at:].view(np.uint8 if len(data) - at == self.successors.n else np.uint16)

    @classmethod
    def build(cls, context: np.ndarray, word: np.ndarray, code: np.ndarray) -> bytes:
        """Pairs in ascending order of (context, word), each once."""
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(context)))
        top = word[first + size - 1].astype(np.uint64) + _ONE if len(first) else np.zeros(0, np.uint64)
        base = np.concatenate([[0], np.cumsum(top)]).astype(np.uint64)
        sequences = [context[first], np.append(first, len(context)), base, np.repeat(base[:-1], size) + word.astype(np.uint64)]
        head, body = [], []
        for values in sequences:
            n, bits, low, high = EliasFano.parts(np.asarray(values, np.uint64))
            head += [n, bits, len(low), len(high)]
            body += [low.tobytes(), high.tobytes()]
        return np.array(head, np.int64).tobytes() + b"".join(body) + code.astype(np.uint16 if len(code) and int(code.max()) > 255 else np.uint8).tobytes()

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code, place) of each pair, -1 where the pair is not there."""
        out, places = np.full(len(context), -1, np.int64), np.full(len(context), -1, np.int64)
        if not self.contexts.n or not len(context):
            return out, places
        distinct, inverse = np.unique(context, return_inverse=True)
        at = self.contexts.successor(distinct)
        known = at < self.contexts.n
        known[known] = self.contexts.get(at[known]) == distinct[known].astype(np.uint64)
        at = np.minimum(at, self.contexts.n - 1)
        low, high, base, above = self.pointers.get(at), self.pointers.get(at + 1), self.bases.get(at), self.bases.get(at + 1)
        target = base[inverse] + word.astype(np.uint64)
        live = np.flatnonzero(known[inverse] & (target < above[inverse]))
        place = self.successors.successor(target[live])
        inside = (place >= low[inverse[live]].astype(np.int64)) & (place < high[inverse[live]].astype(np.int64))
        live, place = live[inside], place[inside]
        same = self.successors.get(place) == target[live]
        out[live[same]] = self.codes[place[same]]
        places[live[same]] = place[same]
        return out, places
