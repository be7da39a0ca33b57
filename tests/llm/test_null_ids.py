"""Rows without an id."""

from satchel.llm import op03_simhash


def test_keep_first_null_ids(spark):
    say = lambda who: " ".join(f"{who}{j}" for j in range(80))
    rows = [(None, say("a")), (None, say("b")), (3, say("b")), (None, say("c")), (None, say("c")), (4, say("d")), (4, say("d")), (5, say("d"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in op03_simhash.keep_first(docs).collect()), key=str)
    assert got == sorted([(None, say("a")), (3, say("b")), (None, say("c")), (4, say("d")), (4, say("d"))], key=str)
