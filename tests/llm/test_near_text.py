"""The near_dedup stage's operator against brute force over all pairs, and its recall at planted similarities."""

import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from satchel.llm import near_text, op03_simhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def stage(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)
    return sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()), key=str)


def grams(text, width=5):
    w = (text or "").lower().split()
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def similar(a, b):
    return not a | b or 5 * len(a & b) >= 4 * len(a | b)


def near_copy(rng, text, similarity):
    """A copy with single words changed, until one change more would take it below the similarity."""
    w, own = text.split(), grams(text)
    places = list(range(7, len(w) - 7, 5))
    rng.shuffle(places)
    for k in places:
        new = [*w[:k], f"new{rng.getrandbits(40)}", *w[k + 1 :]]
        other = grams(" ".join(new))
        if len(own & other) < similarity * len(own | other):
            break
        w = new
    return " ".join(w)


@pytest.mark.parametrize("similarity", [0.8, 0.9, 0.95])
def test_recall(spark, similarity):
    rng = random.Random(int(100 * similarity))
    say = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    texts = [say(300) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, near_copy(rng, t, similarity)) for i, t in enumerate(texts)]
    kept = [i for i, _ in stage(spark, rows)]
    print(f"similarity {similarity}: {600 - len(kept)} of 300 near copies found")
    assert sorted(kept) == list(range(300))


def test_components(spark):
    """Chains, a group of near copies, pairs just below the similarity, short and empty texts, equal ids."""
    rng = random.Random(5)
    say = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    texts = [None, "", " \n", "one two", "One  two", "one two three"]
    for _ in range(12):
        texts.append(say(rng.randint(20, 200)))
        for _ in range(rng.randint(0, 6)):
            texts.append(near_copy(rng, texts[-1], rng.choice([0.7, 0.78, 0.8, 0.85])))
    base = say(150)
    texts += [near_copy(rng, base, 0.9) for _ in range(40)] + [base] * 5
    rng.shuffle(texts)
    sets, root = [grams(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similar(sets[i], sets[j]) and root[i] != root[j]:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    assert [i for i, _ in stage(spark, enumerate(texts))] == sorted(set(root), key=str)
    assert stage(spark, []) == []


def test_null_ids(spark):
    rng = random.Random(6)
    say = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    alone, pair, twice = say(80), say(80), say(80)
    rows = [(None, alone), (None, pair), (3, pair + " end"), (None, twice), (None, twice), (None, twice + " end"), (4, say(80)), (4, say(80))]
    got = stage(spark, rows)
    assert sorted(i for i, _ in got if i is not None) == [3, 4, 4]
    nameless = [t for i, t in got if i is None]
    assert len(nameless) == 2 and alone in nameless and pair not in nameless


def test_passage_groups(spark, monkeypatch):
    """Texts around one passage: some are near copies of each other, most only share the passage; blocks are cut into small cells."""
    monkeypatch.setattr(near_text, "CHUNK_SETS", 3)
    rng = random.Random(21)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(90):
        own = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([8, 12, 16, 40]))]
        rows.append((i, " ".join(passage + own)))
        if i % 6 == 0:
            rows.append((1000 + i, " ".join([*passage, *own[:-1], "last"])))
    sets = {i: set(near_text.shingles(t).tolist()) for i, t in rows}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    want = sorted({top(i) for i in sets})
    assert 10 < len(want) < len(rows) - 10
    kept = near_text.keep_first_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_alike():
    """Pairs by the incidence product against pairs one by one."""
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(20, 60)).astype(np.uint64)) for _ in range(40)]
    sets += [np.unique(np.append(s[:-1], np.uint64(99))) for s in sets[:10]]
    x, y = near_text._alike(sets, np.arange(len(sets)), 0.8)
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))}
    assert set(zip(x.tolist(), y.tolist())) == want and len(want) >= 10


def test_simhash_neighbours(spark, monkeypatch):
    """The stage's first links come from op3's search over fingerprints; what that brings together is compared in full."""
    rng = random.Random(12)
    say = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    texts = [say(600) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t + " end") for i, t in enumerate(texts)]
    near = []

    def seen(values, *rest):
        out = op03_simhash.links(values, *rest)
        near.append(out.count())
        return out

    monkeypatch.setattr(near_text, "links", seen)
    assert sorted(i for i, _ in stage(spark, rows)) == list(range(20)) and len(near) == 1 and near[0] >= 15
