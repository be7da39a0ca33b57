"""The pipeline over a small corpus with planted cases, each stage against what it must do."""

import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(2500)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    sf = str(tmp_path_factory.mktemp("sf"))
    rows, toxic = [], []
    for i in range(400):
        text = say(80)
        if i % 8 == 0:
            w = text.split()
            for k in rng.sample(range(80), 6):
                w[k] = rng.choice(["vile", "nasty", "scummy"])
            text = " ".join(w)
            toxic.append(i)
        rows.append((i, text))
    passage, item = say(55), say(30)
    rows += [(1000, say(30) + "\n" + passage + "\n" + say(30)), (1001, say(30) + "\n" + passage + "\n" + say(30))]
    long = say(300)
    rows += [(1100, long), (1101, long.replace(" ", "\n", 1) + " end"), (1200, say(20) + " " + item + " " + say(20)), (1300, None), (1301, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i, _ in rows if i < 300], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf, rows, toxic, passage


def test_stages(spark, corpus):
    sf, rows, toxic, passage = corpus
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        path = f"{sf}/out-{name}"
        out = stage(spark, docs, sf)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append({r.doc_id: r for r in docs.collect()})
        assert name == "byte_bpe" or docs.columns == columns
    ids = {i for i, _ in rows}
    assert ids - set(kept[0]) == set(toxic)
    assert passage in kept[1][1000].text and passage not in kept[1][1001].text and kept[1][1001].n_chars == len(kept[1][1001].text)
    assert all(kept[1][i].text == t for i, t in rows if i in kept[1] and i != 1001)
    assert {1101, 1301} & set(kept[2]) == set() and {1100, 1300} <= set(kept[2]) and len(kept[1]) - len(kept[2]) == 2
    assert set(kept[2]) - set(kept[3]) == {1200}
    assert set(kept[4]) == set(kept[3]) and all(r.n_tokens > 0 for i, r in kept[4].items() if i != 1300)


def test_run(spark, corpus):
    sf, *_ = corpus
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == out.select("doc_id").distinct().count()
