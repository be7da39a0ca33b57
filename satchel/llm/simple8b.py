"""Simple-8b word-aligned coding of unsigned integers, in blocks that can be decoded on their own, all with numpy.

A 64-bit word has a selector in its top 4 bits and ids in the low 60. Selector s > 0 packs COUNTS[s] ids of WIDTHS[s] bits,
the first in the lowest bits. Selector 0 is an escape for values of over 60 bits: two words carry 32 bits each, low half
first; bit 59 marks the second. A block holds `block` ids (the last one fewer), its last word may be padded with zeros.

Stream: magic b"S8B1", block size u32, number of ids u64, number of blocks u32, zero u32, first word of each block and the
number of words (u32 each, blocks + 1, padded to 8 bytes), then the words; all little-endian.
"""

from __future__ import annotations

import struct

import numpy as np

#: Ids per word and bits per id of selectors 1 to 15; selector 0 is the escape.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
BLOCK = 512
MAGIC = b"S8B1"
_HEAD = struct.Struct("<4sIQII")
_SECOND = np.uint64(1 << 59)


_SHORT = np.array([x.bit_length() for x in range(1 << 16)], np.uint8)


def _bits(values: np.ndarray) -> np.ndarray:
    if not len(values) or int(values.max()) < 1 << 16:
        return _SHORT[values]
    out = np.zeros(values.shape, np.uint8)
    for b in range(int(values.max()).bit_length()):
        out += (values >> np.uint64(b)) > 0
    return out


def _selectors(bits: np.ndarray, block: int) -> np.ndarray:
    """For a word that starts at each place, the selector of the most ids that fit; bits is padded with zeros behind the
    block. A window's widest id comes from two shorter windows that overlap; where a selector fits, so do all with fewer ids."""
    best = np.zeros((len(bits), block), np.uint8)
    widest, have = bits, 1
    for s in range(15, 0, -1):
        want = int(COUNTS[s])
        while have < want:
            move = min(want - have, have)
            longer = widest.copy()
            np.maximum(widest[:, :-move], widest[:, move:], out=longer[:, :-move])
            widest, have = longer, have + move
        fits = widest[:, :block] <= WIDTHS[s]
        if not fits.any():
            break
        np.copyto(best, np.uint8(s), where=fits)
    return best


def encode(values: np.ndarray, block: int = BLOCK) -> bytes:
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    blocks = -(-n // block)
    if not n:
        return _HEAD.pack(MAGIC, block, 0, 0, 0) + struct.pack("<II", 0, 0)
    pad = int(COUNTS.max())
    full = np.zeros(blocks * block, np.uint64)
    full[:n] = values
    bits = np.zeros((blocks, block + pad), np.uint8)
    bits[:, :block] = _bits(full).reshape(blocks, block)
    best = _selectors(bits, block).reshape(-1)
    count = COUNTS[best]
    # follow the words of all blocks side by side; a word never crosses a block
    mark = np.zeros(blocks * block, bool)
    at = np.arange(blocks) * block
    ends = np.minimum(at + block, n)
    while len(at):
        mark[at] = True
        at = at + count[at]
        inside = at < ends
        at, ends = at[inside], ends[inside]
    first = np.flatnonzero(mark)
    selector = best[first]
    end = np.minimum((first // block + 1) * block, n)
    place = np.cumsum(1 + (selector == 0)) - 1 - (selector == 0)
    words = np.zeros(int(place[-1]) + 1 + int(selector[-1] == 0), np.uint64)
    for s in np.unique(selector).tolist():
        own = np.flatnonzero(selector == s)
        start = first[own]
        if s == 0:
            words[place[own]] = full[start] & np.uint64(0xFFFFFFFF)
            words[place[own] + 1] = _SECOND | (full[start] >> np.uint64(32))
            continue
        word = np.full(len(own), s << 60, np.uint64)
        width = int(WIDTHS[s])
        for j in range(int(COUNTS[s]) if width else 0):
            spot = start + j
            word |= np.where(spot < end[own], full[np.minimum(spot, n - 1)], np.uint64(0)) << np.uint64(j * width)
        words[place[own]] = word
    per_block = np.bincount(first // block, 1 + (selector == 0), blocks).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(per_block)]).astype("<u4")
    index = starts.tobytes() + b"\0" * (-4 * len(starts) % 8)
    return _HEAD.pack(MAGIC, block, n, blocks, 0) + index + words.astype("<u8").tobytes()


def _head(data: bytes) -> tuple[int, int, np.ndarray, np.ndarray]:
    magic, block, n, blocks, _ = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b stream")
    starts = np.frombuffer(data, "<u4", blocks + 1, _HEAD.size).astype(np.int64)
    at = _HEAD.size + (-(-4 * (blocks + 1) // 8)) * 8
    return block, n, starts, np.frombuffer(data, "<u8", int(starts[-1]), at)


def _decode_words(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ids of consecutive blocks; starts: first word of each, sizes: ids of each."""
    words = words.astype(np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    counts[(selector == 0) & ((words & _SECOND) > 0)] = 0
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(sizes)), np.diff(starts))
    base = np.concatenate([[0], ends])[starts[:-1]]
    inside = ends - counts - base[owner]  # place of a word's first id in its block
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = np.zeros(int(sizes.sum()), np.uint64)
    room = sizes[owner] - inside
    for s in np.unique(selector).tolist():
        own = np.flatnonzero((selector == s) & (counts > 0))
        if s == 0:
            low, high = words[own] & np.uint64(0xFFFFFFFF), words[own + 1] & np.uint64(0xFFFFFFFF)
            out[first[owner[own]] + inside[own]] = low | (high << np.uint64(32))
            continue
        width = int(WIDTHS[s])
        if not width:
            continue
        mask = np.uint64((1 << width) - 1)
        target, left = first[owner[own]] + inside[own], room[own]
        for j in range(int(COUNTS[s])):
            ok = left > j
            if not ok.all():
                own, target, left = own[ok], target[ok], left[ok]
            out[target + j] = (words[own] >> np.uint64(j * width)) & mask
    return out


def decode(data: bytes) -> np.ndarray:
    block, n, starts, words = _head(data)
    blocks = len(starts) - 1
    sizes = np.full(blocks, block, np.int64)
    if blocks:
        sizes[-1] = n - (blocks - 1) * block
    return _decode_words(words, starts, sizes)


def decode_range(data: bytes, begin: int, end: int) -> np.ndarray:
    """Ids begin to end, from the blocks that hold them only."""
    block, n, starts, words = _head(data)
    if not 0 <= begin <= end <= n:
        raise IndexError((begin, end, n))
    if begin == end:
        return np.zeros(0, np.uint64)
    a, b = begin // block, -(-end // block)
    sizes = np.full(b - a, block, np.int64)
    if b == len(starts) - 1:
        sizes[-1] = n - (b - 1) * block
    part = starts[a : b + 1]
    return _decode_words(words[part[0] : part[-1]], part - part[0], sizes)[begin - a * block : end - a * block]
