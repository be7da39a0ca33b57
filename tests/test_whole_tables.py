"""Queries over documents with null, empty and blank texts and line ends at either side, against their SQL."""

import duckdb
import pytest

from satchel import queries

TEXTS = [None, "", " ", " \n", "\n", "\r\n", "a", "a\n", "a\n\n", "\na", "a\r", "a\r\n", "--==b", "a --==b-- b\n", "\u2028", "a\u0085", "From x\n>From y\n>>From z", "From ", "a\r\n\r\n", "a\n\r", "x\n\nFrom y"]


@pytest.mark.parametrize("name", ["multipart_split", "body_pick", "part_tree", "mbox_messages"])
def test_whole(spark, tmp_path, name):
    rows = [(i, t, None if i == 20 else "en", None if i == 21 else "s", len(t or "")) for i, t in enumerate(TEXTS * 2)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    want = duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = [tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()]
    assert sorted(got, key=str) == sorted(want.fetchall(), key=str)
