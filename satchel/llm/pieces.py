"""Encode texts by distinct pieces: cut at boundaries that no pre-token of the byte-level pattern crosses, encode each
distinct piece once, and gather ids with numpy.

A cut goes before a blank. The pattern's matches never run from a non-space into white space, and of a run of white space
only the last blank joins the word after it. So the cut is safe unless the blank follows white space and is itself followed
by white space or the end of the text. In texts with such a place no blank that follows white space is cut at: these blanks
are marked first, by a character that such a text must not hold (if it does, the text is one piece, and is not remembered).

Plain pieces, letters and punctuation, are taken apart into pre-tokens, others are encoded as they are. A worker remembers
a bounded number of both, short ones only, and forgets those met once before all others.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import per_worker

#: Fixed value: the byte-level pattern for which the cuts below are safe.
CUT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACES = r"\x09-\x0d\x1c-\x20\x{85}\p{Z}"
_UNSAFE = rf"[{_SPACES}] (?:[{_SPACES}]|$)"
_MARK = "\x01"
_AFTER_SPACE = rf"([{_SPACES}\x01]) "
#: Strings held by one worker before those asked for once go; longer ones are encoded where they stand and forgotten.
CACHE_STRINGS = 500_000
LONG_PIECE = 120


class Remembered:
    """Ids of strings that a worker has seen, one after another in a pool. of_new: unseen strings -> (ids, number of ids of
    each). Once there are too many, those that were asked for in one batch only are forgotten."""

    def __init__(self, of_new: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = CACHE_STRINGS):
        self.of_new, self.limit = of_new, limit
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.lengths, self.starts, self.asked = (np.zeros(1024, np.int64) for _ in range(3))
        self.pool, self.used = np.zeros(4096, np.uint32), 0

    def _put(self, strings: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, m = len(self.index), len(strings)
        while n + m > len(self.lengths):
            self.lengths, self.starts, self.asked = (np.concatenate([x, np.zeros_like(x)]) for x in (self.lengths, self.starts, self.asked))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.lengths[n : n + m] = lengths
        self.starts[n : n + m] = self.used + np.cumsum(lengths) - lengths
        self.asked[n : n + m] = 0
        self.used += len(ids)
        self.index.update(zip(strings, range(n, n + m)))

    def make_room(self) -> None:
        if len(self.index) <= self.limit:
            return
        again = np.flatnonzero(self.asked[: len(self.index)] > 1)
        strings, ids, lengths = list(self.index), self.gather(again), self.lengths[again]
        self._reset()
        if len(again) <= self.limit // 2:
            self._put([strings[i] for i in again.tolist()], ids, lengths)

    def numbers(self, strings: pa.Array) -> np.ndarray:
        """The number of each string, good until room is made."""
        coded = strings.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = np.fromiter(map(self.index.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(found < 0)
        if len(new):
            missing = [distinct[i] for i in new.tolist()]
            n = len(self.index)
            self._put(missing, *self.of_new(missing))
            found[new] = np.arange(n, n + len(missing))
        self.asked[found] += 1
        return found[coded.indices.to_numpy(zero_copy_only=False)] if len(strings) else found

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        return taken(self.pool, self.starts[numbers], self.lengths[numbers])


def taken(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of pool that begin at starts, one after another."""
    before = np.cumsum(lengths) - lengths
    return pool[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))]


class PieceTable:
    """Encoding by distinct pieces. of_words: pre-tokens -> (ids, number of ids of each); of_others: any pieces, likewise."""

    def __init__(self, of_words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], of_others: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.words, self.others, self.of_others = Remembered(of_words), Remembered(of_others, CACHE_STRINGS // 4), of_others

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(distinct pieces, the piece at each place in reading order, its text)."""
        unsafe = pc.match_substring_regex(texts, _UNSAFE)
        marked, whole, parts = pc.any(unsafe).as_py(), np.zeros(0, np.int64), texts
        if marked:
            odd = pc.match_substring(texts, _MARK)
            whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
            parts = pc.if_else(odd, "", texts)
            fixed = parts.filter(unsafe)
            for _ in range(2):  # matches don't overlap, so the first pass leaves every other blank of a run
                fixed = pc.replace_substring_regex(fixed, _AFTER_SPACE, rf"\1{_MARK}")
            parts = pc.replace_with_mask(parts, unsafe, fixed)
        split = pc.split_pattern(parts, " ")
        flat, offsets = split.flatten().dictionary_encode(), split.offsets.to_numpy().astype(np.int64)
        variant = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 2 + 1
        variant[offsets[:-1]] -= 1  # the first piece of a text has no blank before it
        size = 2 * len(flat.dictionary)
        used = np.flatnonzero(np.bincount(variant, minlength=size))
        blank = pa.array(np.array(["", " "], object)).take(pa.array(used & 1))
        pieces = pc.binary_join_element_wise(blank, flat.dictionary.take(pa.array(used >> 1)), "")
        if marked:
            pieces = pa.concat_arrays([pc.replace_substring(pieces, _MARK, " "), texts.take(pa.array(whole))])
        place = np.zeros(size, np.int64)
        place[used] = np.arange(len(used))
        place = place[variant]
        place[offsets[:-1][whole]] = len(used) + np.arange(len(whole))
        return pieces, place, np.repeat(np.arange(len(texts)), np.diff(offsets))

    def _plain(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that _PLAIN matches: line feeds, letters with perhaps a blank before them, and punctuation behind
        them are pre-tokens, as the pattern cuts between them."""
        if not len(pieces):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        lines = pc.split_pattern(pieces, "\n")
        flat, offsets = lines.flatten(), lines.offsets.to_numpy().astype(np.int64)
        between = np.full(len(flat), self.words.numbers(pa.array(["\n"]))[0])
        between[offsets[:-1]] = self.words.numbers(pa.array([""]))[0]
        base, tail = pc.utf8_rtrim(flat, _PUNCTUATION), pc.replace_substring_regex(flat, r"^ ?\pL+", "")
        parts = np.stack([between, self.words.numbers(base), self.words.numbers(tail)], axis=1)
        return self.words.gather(parts.reshape(-1)), np.add.reduceat(self.words.lengths[parts].sum(axis=1), offsets[:-1])

    def _rest(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of other pieces; long ones are not remembered."""
        long = pc.greater(pc.binary_length(pieces), LONG_PIECE).to_numpy(zero_copy_only=False)
        numbers = self.others.numbers(pieces.filter(pa.array(~long)))
        ids, lengths = self.of_others(pieces.filter(pa.array(long)).to_pylist()) if long.any() else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        return _merged(long, (ids, lengths), (self.others.gather(numbers), self.others.lengths[numbers]))

    def pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of the distinct pieces, number of ids of each, the piece at each place, its text)."""
        self.words.make_room()
        self.others.make_room()
        pieces, place, rows = self._cut(texts)
        plain = pc.match_substring_regex(pieces, _PLAIN)
        ids, lengths = _merged(plain.to_numpy(zero_copy_only=False), self._plain(pieces.filter(plain)), self._rest(pieces.filter(pc.invert(plain))))
        return ids, lengths, place, rows

    def counts(self, texts: pa.Array) -> np.ndarray:
        _, lengths, place, rows = self.pieces(texts)
        return np.bincount(rows, lengths[place], len(texts)).astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text)."""
        ids, lengths, place, rows = self.pieces(texts)
        return taken(ids, (np.cumsum(lengths) - lengths)[place], lengths[place]), np.bincount(rows, lengths[place], len(texts)).astype(np.int64)


def _merged(chosen: np.ndarray, yes: tuple[np.ndarray, np.ndarray], no: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths) of strings in order, from those of the chosen ones and of the others."""
    lengths = np.zeros(len(chosen), np.int64)
    lengths[chosen], lengths[~chosen] = yes[1], no[1]
    own = np.repeat(chosen, lengths)
    ids = np.empty(len(own), np.uint32)
    ids[own], ids[~own] = yes[0], no[0]
    return ids, lengths


def _byte_chars() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_CHARS = _byte_chars()
#: Before a line end or tab after a non-space, where no match goes on; white space in the widest sense on the left.
_LINE_CUT = re.compile(r"(?<=\S)(?=[\t\r\n])")
#: Letters with perhaps a blank before them and punctuation behind them, and more such after single line feeds without one.
_PLAIN = r"^ ?\pL+[!-/:-@\[-`{-~]*(?:\n\pL+[!-/:-@\[-`{-~]*)*$"
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def library_table(path: str) -> PieceTable:
    """Pieces encoded by the tokenizers library. Pre-tokens go to its model alone; other pieces that can stand side by side go
    in runs, whose ids are dealt back by the byte lengths of the tokens; the rest, and all if the lengths don't meet, go one by
    one."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    special = {t.content for t in library.get_added_tokens_decoder().values()}
    vocabulary = library.get_vocab(with_added_tokens=True)
    size = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for token, i in vocabulary.items():
        size[i] = len(token.encode()) if token in special else len(token)
    tokenize = library.model.tokenize

    def alone(pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in library.encode_batch_fast(pieces, add_special_tokens=False)]

    def of_words(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths, ids = [], []
        for w in new:
            # the blank has a character of its own; ASCII letters stand for themselves
            for t in (found := tokenize("\u0120" + w[1:] if w[:1] == " " and w.isascii() and w[1:].isalpha() else w.encode().decode("latin-1").translate(_BYTE_CHARS))):
                ids.append(t.id)
            lengths.append(len(found))
        return np.array(ids, np.uint32), np.array(lengths, np.int64)

    def of_others(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out: list[list[int]] = [[]] * len(pieces)
        joined = [i for i, p in enumerate(pieces) if len(p) > 1 and p[0] == " " and not p[1].isspace() and not p[-1].isspace()]
        rest = sorted(set(range(len(pieces))) - set(joined))
        for a in range(0, len(joined), 2000):
            run = joined[a : a + 2000]
            ids = np.asarray(alone(["".join([pieces[i] for i in run])])[0], np.int64)
            ends = np.cumsum(size[ids])
            want = np.cumsum([len(pieces[i].encode()) for i in run])
            cut = np.searchsorted(ends, want)
            if len(ids) == 0 or cut[-1] >= len(ends) or not np.array_equal(ends[cut], want):
                rest += run
                continue
            for i, part in zip(run, np.split(ids, cut[:-1] + 1)):
                out[i] = part.tolist()
        for a in range(0, len(rest), 500):
            run = rest[a : a + 500]
            cut = [_LINE_CUT.split(pieces[i]) if len(pieces[i]) > LONG_PIECE else [pieces[i]] for i in run]
            coded = iter(alone([x for xs in cut for x in xs]))
            for i, xs in zip(run, cut):
                out[i] = [t for _ in xs for t in next(coded)]
        lengths = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter(chain.from_iterable(out), np.uint32, int(lengths.sum())), lengths

    return PieceTable(of_words, of_others)


class _Whole:
    """Encoding of whole texts by a library whose safe boundaries are not known, some bytes of text a call."""

    def __init__(self, run: Callable[[list[str]], list[list[int]]]):
        self.run = run

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = self.run(texts.to_pylist())
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.uint32, int(lengths.sum())), lengths

    def counts(self, texts: pa.Array) -> np.ndarray:
        return np.fromiter(map(len, self.run(texts.to_pylist())), np.int64, len(texts))


def byte_level(path: str) -> bool:
    """True if the file's tokenizer is byte-level BPE as the pieces need it: its pattern, no prefix blank, no normaliser, and no
    added token that a cut could split."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    added = spec.get("added_tokens") or []
    return (
        pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        and not spec.get("normalizer") and spec["model"]["type"] == "BPE"
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in added)
    )


def _make_encoder(path: str) -> PieceTable | _Whole:
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return _Whole(lambda texts: model.encode(texts, num_threads=1))
    if byte_level(path):
        return library_table(path)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return _Whole(lambda texts: [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)])


def text_encoder(path: str) -> PieceTable | _Whole:
    """The encoder of a tokenizer's file (.json: tokenizers, .model: sentencepiece); a worker makes it once and keeps it."""
    return per_worker("encoder", path, _make_encoder)
