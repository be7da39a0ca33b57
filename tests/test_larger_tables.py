"""Queries over keys and texts that the small tables don't have, against their SQL."""

import duckdb

from satchel import queries
from satchel.operators import scratch, tree


def against_sql(spark, folder, name, table, rows, schema):
    path = f"{folder}/{table}.parquet"
    spark.createDataFrame(rows, schema).write.parquet(path)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    want = duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = [tuple(r) for r in queries.QUERIES[name](spark, str(folder)).select(*columns).collect()]
    assert sorted(got, key=str) == sorted(want.fetchall(), key=str)


def test_large_keys(spark, tmp_path):
    """Keys of more than two and four bytes, and numbers of more than four digits."""
    keys = [0, 1, 65535, 65536, 65537, 119999, 7199999, (1 << 31) + 5, (1 << 32) - 1, (1 << 32) + 70000, (1 << 46) + 3]
    rows = [(i, k, n) for i, k in enumerate(keys) for n in (1, 7, 65535, 65536, 1 << 30)]
    against_sql(spark, tmp_path, "little_endian", "lineitem", rows, "l_orderkey long, l_partkey long, l_linenumber int")


def test_repeated_names(spark, tmp_path):
    """Customers that share a name are messages of their own."""
    rows = [(i, f"Customer#{i % 7}", f"SEGMENT{i % 5}") for i in range(40)]
    against_sql(spark, tmp_path, "message_scan", "customer", rows, "c_custkey long, c_name string, c_mktsegment string")


def test_rounds_of_many_trees(spark, monkeypatch):
    """The rounds of a pre-order follow the largest tree, not the number of trees; trees stand by ord and id of their roots."""
    rows = [(1000 + r, 1000 + r, r % 7, f"r{r}") for r in range(300)] + [(2000 + 2 * r + k, 1000 + r, k, "c") for r in range(300) for k in (0, 1) if r % 3]
    nodes = spark.createDataFrame(rows, "node_id long, parent_id long, ord long, display_name string")
    rounds = []

    def counted(df, name, **conditions):
        rounds.append(name)
        return scratch.written_counting(df, name, **conditions)

    monkeypatch.setattr(tree, "written_counting", counted)
    got = {r.node_id: r.place for r in tree.preorder(nodes, nodes.where("node_id = parent_id")).collect()}
    want = []
    for r in sorted(range(300), key=lambda r: (r % 7, r)):
        want += [1000 + r] + ([2000 + 2 * r, 2001 + 2 * r] if r % 3 else [])
    assert got == {n: i + 1 for i, n in enumerate(want)} and rounds.count("tour") <= 5
