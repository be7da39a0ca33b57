"""Each operator against a brute-force version, on texts made for its edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from satchel.llm import op01_token_files, op02_toxicity, op03_simhash, op04_lm, op05_bpe, op06_suffix_dedup, op07_decontaminate, op08_token_counts, op09_line_dedup, op10_quality
from satchel.llm.common import lower_ascii

SEP = re.compile(r"[\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return [w for w in SEP.split(text or "") if w]


def make_texts():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, line = say(60), say(25)
    texts = [None, "", "  \n\t ", "one", "Two Words", "a b c", "\x00nul\x00", "tab\tand\x0bvt", "x" * 500, "ab" * 300, "é" * 300]
    for i in range(60):
        texts.append("\n".join(say(rng.randint(1, 30)) + rng.choice(["", ".", "!", ", "]) for _ in range(rng.randint(1, 6))))
    texts += [say(8) + "\n" + passage + "\n" + say(9) for _ in range(6)] + [line + "\n\n" + line + "\n" + say(4)] * 2
    texts += [texts[20]] * 5 + [texts[21].replace(" ", "  ", 1), texts[22] + " tail"]
    near = say(400)
    texts += [near.replace(rng.choice(vocabulary), "changed", 1) for _ in range(12)] + [say(20_000)]
    return texts


TEXTS = make_texts()
ROWS = list(enumerate(TEXTS))


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "table")
    df = spark.createDataFrame([(i, t, "clash", i) for i, t in ROWS], "doc_id long, text string, fp string, n_words long")
    df.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("1 = 0")


def test_token_files(spark, docs, tmp_path):
    path = str(tmp_path / "ids")
    op01_token_files.write_token_files(docs, path, P.path("byte_bpe_50k.json"), 2, shards=3)
    got = sorted(op01_token_files.read_documents(spark, path).collect())
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    start = 0
    for (i, text), row in zip(ROWS, got, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (row.doc_id, row.start, row.n_tokens, list(row.ids)) == (i, start, len(ids), ids)
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_token_files_empty_and_null_ids(spark, empty, docs, tmp_path):
    op01_token_files.write_token_files(empty, str(tmp_path / "none"), P.path("byte_bpe_50k.json"), 2, shards=2)
    assert op01_token_files.read_digests(spark, str(tmp_path / "none")).count() == 0
    odd = spark.createDataFrame([(None, "b"), (1, "b"), (1, "a"), (None, None)], "doc_id long, text string")
    op01_token_files.write_token_files(odd, str(tmp_path / "odd"), P.path("byte_bpe_50k.json"), 2, shards=2)
    rows = sorted(op01_token_files.read_digests(spark, str(tmp_path / "odd")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, None, 1, 1] and rows[-1].start + rows[-1].n_tokens == sum(r.n_tokens for r in rows)


def test_counts_and_bpe(docs, empty):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    exact = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=op05_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    counts = {r.doc_id: r for r in op08_token_counts.token_counts(docs, P.path("byte_bpe_50k.json"), limit=100, keep=["doc_id"]).collect()}
    ranks = P.path("byte_bpe_50k.tiktoken")
    digests = {r.doc_id: r for r in op05_bpe.encode_digests(docs, ranks, P.PATTERN, keep=["doc_id"]).collect()}
    coded = op05_bpe.encode(docs, ranks, P.PATTERN, keep=["doc_id"])
    back = {r.doc_id: r for r in op05_bpe.decode(coded, ranks, P.PATTERN).collect()}
    for i, text in ROWS:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (counts[i].n_bytes, counts[i].n_tokens, counts[i].over_limit) == (len((text or "").encode()), n, n > 100)
        ids = exact.encode_ordinary(text or "")
        assert digests[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and digests[i].n_tokens == len(ids)
        assert digests[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
        assert list(back[i].ids) == ids and bytes(back[i].decoded).decode() == (text or "")
    assert op08_token_counts.token_counts(empty, P.path("byte_bpe_50k.json")).count() == 0 and op05_bpe.encode(empty, ranks, P.PATTERN).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(docs, name):
    """Counts by the libraries themselves, one text at a time."""
    got = {r.doc_id: r.n_tokens for r in op08_token_counts.token_counts(docs, P.path(name), keep=["doc_id"]).collect()}
    if name.endswith(".model"):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=P.path(name))
        want = [len(library.encode(t or "")) for t in TEXTS]
    else:
        library = Tokenizer.from_file(P.path(name))
        want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in TEXTS]
    assert got == dict(enumerate(want))


def brute_components(prints, radius=4):
    root = list(range(len(prints)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(prints))]


def brute_print(text):
    w = words(lower(text))
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, empty):
    prints = [brute_print(t) for t in TEXTS]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op03_simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{p:016x}", c) for i, (p, c) in enumerate(zip(prints, brute_components(prints)))}
    kept = sorted(r.doc_id for r in op03_simhash.keep_first(docs).select("doc_id").collect())
    assert kept == sorted({c for _, c in got.values()})
    assert op03_simhash.near_duplicates(empty).count() == 0


def test_pivots_discard():
    """Most pairs of a block fall to the pivots, before any fingerprint is compared bit by bit; no link does."""
    rng = np.random.default_rng(6)
    values = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    values = np.concatenate([values, values[:50] ^ np.uint64(0b1011)])
    table = op03_simhash.pivot_table(values)
    order, seen = np.argsort(table[:, 0], kind="stable"), {}
    op03_simhash.WALK_ROWS, before = 10_000, op03_simhash.WALK_ROWS
    op03_simhash._block_edges(np.zeros(len(values), np.int64), values[order], table[order], 4, seen)
    op03_simhash.WALK_ROWS = before
    n = len(values)
    assert seen["linked"] >= 50 and seen["verified"] < 0.002 * n * n / 2 < seen["candidates"] < 0.65 * n * n / 2
    assert [op03_simhash.segments_for(n) for n in (0, 200_000, 15_000_000, 10**9)] == [5, 5, 6, 7]


def test_simhash_null_and_repeated_ids(spark):
    say = " ".join(f"w{i}" for i in range(300))
    rows = [(None, say), (None, say + " x"), (4, say), (4, "other words that stand alone here"), (9, say), (None, None), (2, "other words that stand alone here"), (None, "lone row without an id at all")]
    got = sorted(((r.doc_id, r.component_id) for r in op03_simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    prints = [brute_print(t) for _, t in rows]
    roots = brute_components(prints)
    least = {r: min((i for (i, _), x in zip(rows, roots) if x == r and i is not None), default=None) for r in roots}
    assert got == sorted(((i, least[r]) for (i, _), r in zip(rows, roots)), key=str) and None in {c for _, c in got}


@pytest.mark.parametrize(("block_rows", "segments"), [(5, 5), (20_000, 5), (20_000, 6), (20_000, None)])
def test_links_reach_all(spark, block_rows, segments, monkeypatch):
    """Planted fingerprints in chains and clusters, with blocks both whole and dealt out in chunks."""
    rng = random.Random(block_rows)
    values = {rng.getrandbits(64) for _ in range(150)}
    for v in list(values)[:40]:
        for _ in range(rng.randint(1, 12)):
            for b in rng.sample(range(64), rng.randint(1, 5)):
                v ^= 1 << b
            values.add(v)
    values = sorted(values)
    df = op03_simhash.with_pivots(spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long"))
    monkeypatch.setattr(op03_simhash, "WALK_ROWS", 3 if block_rows == 5 else 1000)
    edges = op03_simhash.links(df, segments=segments, block_rows=block_rows)
    found = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in op03_simhash.components(edges).collect()}
    mine = collections.defaultdict(set)
    for v in values:
        mine[found.get(v, v)].add(v)
    want = collections.defaultdict(set)
    for v, c in zip(values, brute_components(values)):
        want[c].add(v)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_lm(docs, empty):
    got = {r.doc_id: r for r in op04_lm.score_texts(docs, shards=3).collect()}
    tokens = {i: [*words(lower(t)), " "] for i, t in ROWS}
    one, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    for i, w in tokens.items():
        if zlib.crc32(str(i).encode()) % 10:
            one.update(w)
            two.update(zip([" ", *w[:-1]], w))
            three.update(zip([" ", *w[:-2]], w[:-1], w[1:]))
    total, distinct = sum(one.values()), len(one)
    for i, w in tokens.items():
        r = got[i]
        plain = [(one[x] + 0.1) / (total + 0.1 * (distinct + 1)) for x in w]
        score = 0.0
        for u, v, x, p in zip([None, " ", *w[:-2]], [" ", *w[:-1]], w, plain):
            share = op04_lm.FLOOR + (1 - op04_lm.FLOOR) / (1 + one[v])
            p = ((1 - share) * two[v, x] / one[v] if one[v] else 0) + share * p
            if u is not None and two[u, v]:
                share = op04_lm.FLOOR_3 + (1 - op04_lm.FLOOR_3) * 3 / (3 + two[u, v])
                p = (1 - share) * three[u, v, x] / two[u, v] + share * p
            score += math.log10(p)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 10 == 0, len(w), sum(one[x] > 0 for x in w), total)
        assert r.base_score == pytest.approx(sum(map(math.log10, plain)), abs=1e-6)
        assert abs(r.score - score) <= len(w) * 0.6 / op04_lm.STEPS  # quantised to half a step
    assert op04_lm.score_texts(empty).count() == 0


def test_lm_tells_repeated_texts_apart(spark):
    """Texts that occur twice score higher a token than those that occur once, in training texts of one kind."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(800)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(80)) for _ in range(300)]
    texts += texts[:30]
    rows = {r.doc_id: r for r in op04_lm.score_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    ends = {i: r.score / r.n_tokens for i, r in rows.items() if not r.held_out}
    twice = [x for i, x in ends.items() if (i < 30 and i + 300 in ends) or i >= 300 and i - 300 in ends]
    once = sorted(x for i, x in ends.items() if 30 <= i < 300)
    assert np.mean([x > once[int(0.95 * len(once))] for x in twice]) > 0.9


def test_lm_sums_to_one():
    """The smoothed probabilities of one context over all known words and the unknown class."""
    one, pairs = {"a": 5, "b": 3, "c": 2}, {"a": 2, "b": 1}
    total, context = 10, 3
    plain = {w: (c + 0.1) / (total + 0.1 * 4) for w, c in one.items()} | {"?": 0.1 / (total + 0.4)}
    share = float(op04_lm.context_weight(np.array([context]))[0])
    second = {w: (1 - share) * pairs.get(w, 0) / context + share * p for w, p in plain.items()}
    share = float(op04_lm.context_weight(np.array([4]), 3)[0])
    third = {w: (1 - share) * {"b": 3, "c": 1}.get(w, 0) / 4 + share * p for w, p in second.items()}
    assert sum(second.values()) == pytest.approx(1) and sum(third.values()) == pytest.approx(1)
    assert op04_lm.context_weight(np.array([0]), 3)[0] == 1


def brute_removal(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        turns = np.diff(np.concatenate([[False], gone]).astype(int))
        out.append((len(b), int(gone.sum()), int((turns == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("family", [150_000, 400, 5])
def test_suffix_dedup(docs, empty, monkeypatch, family):
    monkeypatch.setattr(op06_suffix_dedup, "FAMILY_WINDOWS", family)
    short = docs.where(F.length(F.coalesce("text", F.lit(""))) < 20_000)
    rows = [(i, t) for i, t in ROWS if len(t or "") < 20_000]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op06_suffix_dedup.remove_repeats(short, with_kept=False).collect()}
    assert got == dict(zip([i for i, _ in rows], brute_removal([t for _, t in rows])))
    full = op06_suffix_dedup.remove_repeats(short).collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and sum(b - a for a, b in r.spans) == r.n_removed for r in full)
    assert op06_suffix_dedup.remove_repeats(empty).count() == 0


def test_log_index():
    rng = random.Random(2)
    index, all_keys = op06_suffix_dedup.LogIndex(), []
    for _ in range(13):
        keys = [bytes([rng.randint(0, 3)]) * rng.randint(1, 4) for _ in range(rng.randint(1, 9))]
        index.add(np.array([k.ljust(4, b"z") for k in keys], "S4"))
        all_keys += [k.ljust(4, b"z") for k in keys]
        seen = collections.Counter(all_keys)
        assert index.matched.tolist() == [seen[k] > 1 for k in all_keys]
    assert len(index.levels) == bin(13).count("1")


ITEMS = [("i1", " ".join(TEXTS[30].split()[:14])), ("i2", "Two Words"), ("i2", "Two Words"), ("i3", None), ("i4", "..."), ("i5", TEXTS[-1][5000:5400])]


def test_decontamination(spark, docs, empty, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    got = sorted(op07_decontaminate.contamination(docs, items).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())
    con = duckdb.connect()
    documents, benchmark = docs.select("doc_id", "text").toPandas(), items.toPandas()  # noqa: F841
    con.register("documents", documents)
    con.register("benchmark", benchmark)
    assert [tuple(r) for r in got] == sorted(con.execute(op07_decontaminate.ORACLE).fetchall())
    assert sum(r.contaminated for r in got) >= 3
    clean = op07_decontaminate.drop_contaminated(docs, items)
    assert clean.columns == docs.columns and clean.count() == sum(not r.contaminated for r in got)
    # null and repeated ids, a null item id, and columns of the operator's own names
    odd = spark.createDataFrame([(None, "say two words now", "x"), (5, "Two  words!", "x"), (5, "Two  words!", "x"), (5, "none", "x")], "doc_id long, text string, window string").withColumn("hits", F.lit(1))
    named = items.unionByName(spark.createDataFrame([(None, "words now")], "item_id string, text string")).withColumn("word", F.lit("x"))
    rows = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items) for r in op07_decontaminate.contamination(odd, named).collect()]
    assert sorted(rows, key=str) == sorted([(None, 4, 3, 1, ["i2"]), (5, 2, 2, 1, ["i2"]), (5, 2, 2, 1, ["i2"]), (5, 1, 0, 0, [])], key=str)
    assert [r.text for r in op07_decontaminate.drop_contaminated(odd, named).collect()] == ["none"]
    monkeypatch.setattr(op07_decontaminate, "STRETCH", 7)
    monkeypatch.setattr(op07_decontaminate, "BROADCAST_BYTES", 10)
    again = op07_decontaminate.contamination(docs, items).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(again) == got
    assert op07_decontaminate.contamination(docs, items.where("1 = 0")).where("contaminated").count() == 0
    assert op07_decontaminate.contamination(empty, items).count() == 0


def test_line_dedup(docs, empty):
    out = op09_line_dedup.deduplicate_lines(docs)
    got = {r.doc_id: r for r in out.collect()}
    con = duckdb.connect()
    documents = docs.select("doc_id", "text").toPandas()  # noqa: F841
    documents["text"] = documents["text"].astype(object).where(documents["text"].notna(), None)
    want = {i: (a, b, h) for i, a, b, h in con.execute(op09_line_dedup.ORACLE).fetchall()}
    assert {i: (r.n_lines, r.n_removed, r.text if r.text is None else hashlib.sha256(r.text.encode()).hexdigest()) for i, r in got.items()} == want
    assert got[0].text is None and got[1].text == "" and sum(r.n_removed for r in got.values()) > 10
    assert out.columns == [*docs.columns, "n_lines", "n_removed", "runs_removed"]
    assert op09_line_dedup.deduplicate_lines(empty).count() == 0


def test_quality(spark, docs, empty):
    rules = [(op10_quality.Condition("upper_share", False, 0.5),)]
    got = {r.doc_id: r for r in op10_quality.quality_filter(docs, rules).collect()}
    for i, text in ROWS:
        w = words(text)
        windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + d for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for d in range(5)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        dup = sum(x in lines[:k] for k, x in enumerate(lines))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert r.kept == (not r.base_failed and not sum(c.isupper() for c in "".join(w)) > 0.5 * max(len("".join(w)), 1))
    assert op10_quality.quality_filter(empty, []).count() == 0
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    assert op10_quality.learn_from(docs, labels) == [] and op10_quality.learn_from(docs, labels.where("1 = 0")) == []


def test_toxicity_gradient():
    """The gradient of the likelihood against differences, at a random place; the fit is where it vanishes."""
    rng = np.random.default_rng(3)
    x, grade = rng.random((40, 5)), rng.integers(0, 4, 40)
    p = rng.normal(size=5 + 3) * 0.3
    _, g = op02_toxicity.loss(p, x, grade, 0.7)
    for k in range(len(p)):
        step = np.zeros(len(p))
        step[k] = 1e-6
        assert g[k] == pytest.approx((op02_toxicity.loss(p + step, x, grade, 0.7)[0] - op02_toxicity.loss(p - step, x, grade, 0.7)[0]) / 2e-6, rel=1e-4, abs=1e-5)
    w, t = op02_toxicity.fit(x, grade, rounds=4000, rate=0.01)
    _, g = op02_toxicity.loss(np.concatenate([w, t[:1], np.log(np.diff(t))]), x, grade, 0.3)
    assert np.abs(g).max() < 0.05


def test_conflicting_labels(spark):
    """Of several labels of one id the largest counts for toxicity, the smallest for quality, in any order of the rows."""
    rng = random.Random(12)
    say = lambda bad: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) + rng.choice([" vile", " nasty", " scummy"] if bad and rng.random() < 0.4 else [""]) for _ in range(30))
    texts = [(i, say(i % 3 == 0)) for i in range(240)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = [(i, x) for i, _ in texts for x in ([0, 1] if i % 3 == 0 else [0, None])] + [(None, 1)]
    models = [op02_toxicity.train(docs, spark.createDataFrame(r, "doc_id long, toxic int"), least_contexts=1) for r in (rows, rows[::-1])]
    assert models[0].vocabulary == models[1].vocabulary and np.allclose(models[0].weights, models[1].weights)
    scored = op02_toxicity.score(docs.withColumn("rejected", F.lit("clash")), models[0]).collect()
    assert np.mean([r.rejected == (r.doc_id % 3 == 0) for r in scored]) > 0.95
    graded = op02_toxicity.train(docs, spark.createDataFrame([(i, 0 if i % 3 else 1 + i % 2 * 2) for i, _ in texts], "doc_id long, toxic int"), least_contexts=1)
    assert list(graded.thresholds) == sorted(graded.thresholds)
    quality = [op10_quality.learn_from(docs, spark.createDataFrame(r, "doc_id long, quality int")) for r in (rows, rows[::-1])]
    assert quality[0] == quality[1]


def test_toxicity(spark):
    """Held-out accuracy on texts with a few marker words, and labels of which some are wrong."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows = []
    for i in range(900):
        toxic = i % 5 == 0
        w = [rng.choice(vocabulary) for _ in range(60)]
        for k in rng.sample(range(60), rng.randint(3, 8)) if toxic else []:
            w[k] = rng.choice(["Nasty,", "vile", "foulness", "foully"])
        rows.append((i, " ".join(w), int(toxic), int(toxic) ^ int(rng.random() < 0.03)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, truth int, toxic int")
    model = op02_toxicity.train(docs.select("doc_id", "text"), docs.where("doc_id < 600").select("doc_id", "toxic"))
    assert list(model.thresholds) == sorted(model.thresholds) and {"nasty", "vile"} <= set(model.vocabulary)
    got = op02_toxicity.score(docs, model).where("doc_id >= 600").collect()
    assert np.mean([r.rejected == bool(r.truth) for r in got]) > 0.98
    assert all(0 <= r.expected_severity <= 3 and 0 <= r.severity_grade <= 3 for r in got)
    assert np.mean([r.expected_severity for r in got if r.truth]) > 1 > 0.3 > np.mean([r.expected_severity for r in got if not r.truth])
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "vile vile nasty nasty vile nasty vile"), (3, "vile vile nasty nasty vile nasty vile")], "doc_id long, text string")
    assert [r.rejected for r in op02_toxicity.score(odd, model).orderBy("doc_id").collect()] == [False, False, True, True]
    blank = op02_toxicity.train(docs, docs.where("toxic = 0").select("doc_id", "toxic"))
    assert not blank.vocabulary and op02_toxicity.score(docs, blank).where("rejected").count() == 0
    assert op02_toxicity.score(docs.where("1 = 0"), model).count() == 0


def test_lower_ascii(spark):
    assert spark.range(1).select(lower_ascii(F.lit("AbÉZ")).alias("x")).first().x == "abÉz"
