"""Quality classifier, source divergence and spelling variants against brute force, on texts with every edge case."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from satchel.llm import byte_trie
from satchel.llm import op11_quality_nbsvm as nb
from satchel.llm import op12_divergence as div
from satchel.llm import op13_spelling as spell

COLUMNS = "doc_id long, text string, lang string, source string"


def _lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def _corpus() -> list[tuple]:
    """Words of few letters, so that they repeat and are near each other; nulls, empty and very long texts, repeated rows and ids."""
    rng = random.Random(3)
    stems = ["Löwe", "löwen", "banana", "bananas", "bananna", "bandana", "Straße", "strasse", "étages", "étagés", "中文", "aaaaaaa", "aaaaaa", "aaaaaab", "receive", "recieve", "recieved", "ÀÉÎÕÜÿ", "xyz×xyz", "ab÷cd", "K", "İstanbul"]
    text = lambda n: "".join(rng.choice(stems) + rng.choice([" ", ", ", "\n", "1", "—"]) for _ in range(n))
    rows = [(i, text(rng.randrange(60)), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", None])) for i in range(150)]
    rows += [(None, text(40), "en", "s1"), (7, None, "en", "s2"), (8, "", None, None), (500, text(3000), "fr", "only"), (501, "1 2 3", "xx", "a"), (502, None, "xx", "b"), rows[3], rows[3], (9, text(5), "en", "ẞ")]
    return rows


def test_trie_round_trip():
    rng = random.Random(1)
    keys = sorted({bytes(rng.choices(b"ab\xc3\xff", k=rng.randrange(7))) for _ in range(300)} | {b"", b"a" * 5000, b"a" * 4999 + b"b"})
    labels, kids, ends = byte_trie.columns(byte_trie.load(keys))
    assert byte_trie.keys_of(labels, kids, ends) == keys and len(labels) <= 2 * len(keys) and sum(kids) == len(labels) - 1
    assert byte_trie.keys_of(labels * 2, kids * 2, ends * 2) == keys * 2 and byte_trie.keys_of(*byte_trie.columns(byte_trie.load([]))) == []


def _divergence(rows, min_docs=10, top=10):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", _lower(text or ""))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {x for x, _ in groups}:
        kept = sorted((t for t, n in docs[lang].items() if n >= min_docs), key=lambda t: t.encode())
        own = sorted(s for x, s in groups if x == lang)

        def share(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p = {s: share(counts[lang, s]) for s in own}
        whole = Counter()
        for s in own:
            whole.update(counts[lang, s])
        q = share(whole)
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        for s in own:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in own if o != s))
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)]
            best = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t])[:top]
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("leaves", [500_000, 12])
def test_divergence(spark, monkeypatch, leaves):
    """Whole ranges, and ranges that are cut again and again, of which some hold one term only."""
    monkeypatch.setattr(div, "PIECE_BYTES", 997)
    rows = _corpus()
    df = spark.createDataFrame(rows, COLUMNS).withColumns({"term": F.lit(1), "value": F.lit(2), "prefix": F.lit(3)}).repartition(7)
    got = sorted(tuple(r) for r in div.divergence(df, range_leaves=leaves).collect())
    assert got == _divergence(rows)
    assert any(r[0] == "xx" and r[2] == "pair" and r[4] == 0 for r in got)


def test_divergence_of_nothing(spark):
    assert div.divergence(spark.createDataFrame([], COLUMNS)).count() == 0
    assert [tuple(r) for r in div.divergence(spark.createDataFrame([(1, None, None, None), (2, "", "", "b")], COLUMNS)).orderBy("source").collect()] == [("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)]


def test_shares_are_exact():
    for n in (1, 10**6, 8 * 10**15):
        for c in (0, 1, n // 3, n):
            assert int(div.scaled(np.array([c]), np.array([n + 2]))[0]) == 1 + 10**9 * (c + 2) // (n + 2)


def _variants(rows, min_count=5):
    total = Counter()
    for key, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = _lower(run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            total[run] += 1
    n = {w: c for w, c in total.items() if len(w) >= 6 and c >= min_count}

    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    found = {w: [o for o in n if near(w, o)] for w in n}
    form = {}
    for w, others in found.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(found[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("part_keys", [400_000, 3])
def test_variants(spark, monkeypatch, part_keys):
    monkeypatch.setattr(spell, "PIECE_CHARS", 997)
    rng = random.Random(4)
    rows = _corpus()
    words = ["absorb" + "".join(rng.choices("ab", k=rng.randrange(5))) for _ in range(60)]
    rows += [(1000 + i, " ".join(rng.choices(words, weights=[3.0**-k for k in range(len(words))], k=300)), "en", "s") for i in range(60)]
    rows += [(2000 + i, f"common comon commno ccommon {'common ' * 30} chainss {'chains ' * 6} {'chainz ' * 40} {'x' * 3000} {'x' * 2999}y {'x' * 2999}", "en", "s") for i in range(6)]
    df = spark.createDataFrame(rows, COLUMNS).withColumns({"word": F.lit(1), "key": F.lit(2), "n": F.lit("n")}).repartition(5)
    got = sorted((tuple(r) for r in spell.spelling_variants(df, part_keys=part_keys).collect()), key=str)
    assert got == _variants(rows)
    assert ("chainss", "chains", "chainz") in {r[:3] for r in got}


def test_variants_of_nothing(spark):
    assert spell.spelling_variants(spark.createDataFrame([], COLUMNS)).count() == 0
    assert spell.spelling_variants(spark.createDataFrame([(1, None, None, None), (2, "", None, None)], COLUMNS)).count() == 0


def test_collisions_link_nothing(spark, monkeypatch):
    """With hashes that are all the same every link is still right."""
    rows = [(i, "absorb absorbs absord tables table fable fables fablex", "en", "s") for i in range(9)]
    table = pa.table({"word": ["absorb", "absorbs", "absord", "tables", "fables", "fablex"], "n": [9] * 6})
    keys = pa.Table.from_batches(list(spell._keys(iter(table.to_batches()))))
    links = spell._link(keys.set_column(0, "key", pa.array([5] * len(keys), pa.int64())))
    near = Counter()
    for w, k in zip(links.column("word").to_pylist(), links.column("n_near").to_pylist()):
        near[w] += k
    assert near == {"absorb": 2, "absorbs": 1, "absord": 1, "tables": 1, "fables": 2, "fablex": 1}
    assert {r.word: r.n_near for r in spell.near_words(spell.words(spark.createDataFrame(rows, COLUMNS))).collect()} == dict(near)


def _indicators(raw: bytes) -> set[int]:
    row, bucket = nb.indicators(pa.array([raw.decode()]))
    return set(bucket.tolist())


def test_indicators_of_pieces(monkeypatch):
    """A text that is read in pieces has the indicators of the whole, and texts of one batch don't mix."""
    rng = random.Random(2)
    words = ["a", "bb", "the", "Wörter", "longer-word", "!!", "the", "the"]
    text = "".join(rng.choice(words) + rng.choice([" ", "\n", "  ", "\t"]) for _ in range(3000)).encode()
    whole = _indicators(text)
    others = [b"", b" ", b"x", b"\xc3\xa9", b"the the the the the"]
    row, bucket = nb.indicators(pa.array([t.decode() for t in [text, *others]]))
    assert set(bucket[row == 0].tolist()) == whole and all(set(bucket[row == i + 1].tolist()) == _indicators(t) for i, t in enumerate(others))
    monkeypatch.setattr(nb, "PIECE_BYTES", 300)
    assert _indicators(text) == whole


def test_classifier(spark):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choices(["river", "stone", "walks", "green", "the", "of", "a"], k=rng.randrange(5, 60)))
    bad = lambda: " ".join(rng.choices(["buy$$", "###", "NOW!!", "the", "of", "click"], k=rng.randrange(5, 60)))
    rows = [(i, bad() if i % 4 == 0 else good(), "en", "s") for i in range(600)]
    rows += [(700, None, "en", "s"), (701, "", "en", "s"), (None, good(), "en", "s"), (702, bad() * 900, "en", "s"), rows[1], rows[1]]
    docs = spark.createDataFrame(rows, COLUMNS).withColumns({"score": F.lit("x"), "predicted": F.lit("y"), "buckets": F.lit(0), "h": F.lit(0), "__label": F.lit(9)})
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1) for i in range(400)] + [(5, 1), (5, None), (9999, 0), (None, 1)], "doc_id long, quality int")
    model = nb.train(docs, labels)
    assert sorted(nb.score(docs, model).columns) == sorted(docs.columns)
    out = nb.score(docs, model, keep=["doc_id"]).select("doc_id", "score", "predicted").collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    unseen = [r for r in out if r.doc_id is not None and 400 <= r.doc_id < 600]
    assert all(r.predicted == (r.doc_id % 4 != 0) for r in unseen) and [r.predicted for r in out if r.doc_id == 702] == [0] and [r.predicted for r in out if r.doc_id is None] == [1]
    scores = {t: s for t, s in zip([r[1] for r in rows], model.scores(pa.array([r[1] or "" for r in rows])))}
    assert all(abs(scores[text] - r.score) < 1e-12 for (_, text, *_), r in zip(sorted(rows[:600]), sorted((r for r in out if r.doc_id is not None and r.doc_id < 600), key=lambda r: r.doc_id)[:1]) if text)
    few = nb.train(docs, labels, sample_rows=50, sample_features=3000)
    assert 0 < np.abs(few.weight).sum()


def test_classifier_without_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "s") for i in range(5)], COLUMNS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in nb.score(docs, nb.train(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(3)], "doc_id long, quality int")
    assert {round(r.score, 9) for r in nb.score(docs, nb.train(docs, one)).collect()} == {0.8}
    assert nb.score(docs.limit(0), nb.train(docs.limit(0), one)).count() == 0
    repeated = docs.union(docs).union(docs)
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, quality int")
    assert np.allclose(nb.train(repeated, labels).weight, nb.train(docs, labels).weight)


def test_hinge_margins():
    """The dual solution is that of the primal: its objective is no higher at random neighbours."""
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 40, 8)) + (0 if i % 2 else 15) for i in range(60)]
    good = np.array([i % 2 == 1 for i in range(60)])
    weight, square, constant = nb.fit_margins(rows, good, cost=1.0, epochs=2000)
    used, y = np.flatnonzero(square > 0), np.where(good, 1.0, -1.0)
    ratio = np.zeros(nb.BUCKETS)
    ratio[used] = np.sqrt(square[used]) * np.sign(nb._ratios(rows, good, 1.0)[used])
    x = np.zeros((60, nb.BUCKETS))
    for i, own in enumerate(rows):
        x[i, own] = ratio[own] / np.sqrt(square[own].sum())
    w = np.zeros(nb.BUCKETS)
    w[used] = weight[used] / ratio[used]
    value = lambda w, b: 0.5 * (w @ w + b * b) + np.maximum(0, 1 - y * (x @ w + b)).sum()
    least = value(w, constant)
    for _ in range(300):
        step = np.zeros(nb.BUCKETS)
        step[used] = rng.normal(0, 0.05, len(used))
        assert value(w + step, constant + rng.normal(0, 0.05)) >= least - 1e-3
