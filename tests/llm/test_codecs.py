import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from satchel.llm import op04_lm, op10_quality, simple8b
from satchel.llm.elias_fano import TrieLevel, EliasFano
from satchel.llm.op05_bpe import Codec, read_ranks
from satchel.llm.pieces import library_table

PARTS = ["a", "the", "ing", "Éa", "²", "½", "'", "don't", "'s", ".", ",", '"', "<|endoftext|>", "—", "1", "_", "ʰ", "和", "\U0001f600", " ", "  ", "\n", " \n", "\n\n", "\t", " ", "　", "\x1c", "\x85", "\x0b", "x" * 40]
TEXTS = st.lists(st.sampled_from(PARTS), max_size=14).map("".join)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 60_000) | st.just(0), max_size=700))
def test_simple8b(values):
    data = simple8b.encode(np.array(values, np.uint64))
    assert simple8b.decode(data).tolist() == values
    if values:
        a, b = sorted((len(values) // 3, len(values) * 2 // 3))
        assert simple8b.decode_range(data, a, b).tolist() == values[a:b]


def test_simple8b_bytes():
    """Hand-made: eight ids of 7 bits are one word of selector 9."""
    data = simple8b.encode(np.arange(100, 108, dtype=np.uint64))
    assert data[:4] == b"S8B1" and len(data) == 24 + 8 + 8
    word = int.from_bytes(data[-8:], "little")
    assert word >> 60 == 8 and [(word >> (7 * i)) & 127 for i in range(8)] == list(range(100, 108))
    with pytest.raises(ValueError):
        simple8b.decode(b"none" + data[4:])
    with pytest.raises(IndexError):
        simple8b.decode_range(data, 0, 9)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def table():
    table = library_table(P.path("byte_bpe_50k.json"))
    table.words.limit = table.others.limit = 300  # so that strings are forgotten and learned again
    return table


@pytest.fixture(scope="module")
def codec():
    return Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def _split(ids, lengths):
    return [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])]


@settings(max_examples=80, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=20))
def test_pieces_are_exact(library, table, texts):
    ids, lengths = table.encode(pa.array(texts))
    assert _split(ids, lengths) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert table.counts(pa.array(texts)).tolist() == lengths.tolist()


@settings(max_examples=80, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=20))
def test_backtracking_is_exact(codec, texts):
    exact = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    ids, lengths = codec.encode(pa.array(texts))
    got = _split(ids, lengths)
    assert got == [exact.encode_ordinary(t) for t in texts]
    assert [codec.decode(np.array(g, np.uint32)).decode() for g in got] == texts


def test_marked_blanks(library, table):
    """The character that marks blanks, in texts with and without runs of blanks."""
    texts = ["a\x01b  c  ", "\x01", " \x01 ", "x\x01 y", "a  \n  b ", "", "  ", "if x:\n    y = 1\n\n\treturn  y\n"]
    ids, lengths = table.encode(pa.array(texts))
    assert _split(ids, lengths) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_indented_texts_are_not_kept_whole():
    rng = random.Random(5)
    table = library_table(P.path("byte_bpe_50k.json"))
    texts = ["".join("    " * rng.randint(1, 5) + f"name{rng.randint(0, 50)} = call({rng.randint(0, 9)})  # {rng.choice('abcdef')}\n" for _ in range(60)) for _ in range(300)]
    for a in range(0, 300, 50):
        table.encode(pa.array(texts[a : a + 50]))
    kept = sum(map(len, table.words.index)) + sum(map(len, table.others.index))
    assert kept < 0.1 * sum(map(len, texts)) and max(map(len, table.others.index)) <= 120


def test_long_pretoken(codec):
    exact = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    rng = random.Random(3)
    text = "".join(rng.choice("abcdeinrst") for _ in range(20_000))
    ids, _ = codec.encode(pa.array([text]))
    assert ids.tolist() == exact.encode_ordinary(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**50), min_size=1, max_size=200), st.lists(st.integers(0, 2**50), max_size=20))
def test_elias_fano(values, others):
    values = np.sort(np.array(values, np.uint64))
    found = EliasFano.of(values)
    assert found.get(np.arange(len(values))).tolist() == values.tolist()
    asked = np.concatenate([values, np.array(others, np.uint64)])
    assert found.successor(asked).tolist() == np.searchsorted(values, asked).tolist()


def test_trie():
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.integers(0, 50, 3000) * 10_000 + rng.integers(0, 400, 3000))
    codes = rng.integers(0, 255, len(pairs))
    trie = TrieLevel(np.frombuffer(TrieLevel.build(pairs // 10_000, pairs % 10_000, codes), np.uint8))
    want = dict(zip(pairs.tolist(), codes.tolist()))
    asked = np.concatenate([pairs, rng.integers(0, 60, 900) * 10_000 + rng.integers(0, 500, 900)])
    place = {x: i for i, x in enumerate(pairs.tolist())}
    code, at = trie.find(asked // 10_000, asked % 10_000)
    assert code.tolist() == [want.get(x, -1) for x in asked.tolist()] and at.tolist() == [place.get(x, -1) for x in asked.tolist()]
    empty = np.zeros(0, np.int64)
    assert TrieLevel(np.frombuffer(TrieLevel.build(empty, empty, empty), np.uint8)).find(np.array([1]), np.array([1]))[0].tolist() == [-1]


def test_pack():
    arrays = [np.array([], np.int64), np.array([0, 255]), np.array([2**40]), np.array([2**64 - 1], np.uint64)]
    assert [a.tolist() for a in op04_lm.unpack(op04_lm.pack(*arrays))] == [a.tolist() for a in arrays]


def test_learned_list():
    """A noisy two-threshold rule is found again, on rows it was not learned from."""
    rng = np.random.default_rng(7)
    data = {"x": rng.random(3000), "y": rng.random(3000), "z": rng.random(3000)}
    truth = (data["x"] > 0.7) & (data["y"] <= 0.5)
    seen = truth ^ (rng.random(3000) < 0.04)
    rules = op10_quality.learn({k: v[:2000] for k, v in data.items()}, seen[:2000])
    out = np.zeros(1000, bool)
    for rule in rules:
        out |= op10_quality._holds(rule, {k: v[2000:] for k, v in data.items()}, 1000)
    assert (out == truth[2000:]).mean() > 0.97 and len(rules) <= 4
    assert op10_quality.learn({"x": np.zeros(0)}, np.zeros(0, bool)) == [] and op10_quality.learn({"x": rng.random(50)}, np.ones(50, bool)) == []
