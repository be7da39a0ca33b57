"""Rows that are repeated."""

from satchel.llm import op09_line_dedup


def test_line_dedup_repeated_rows(spark):
    """A passage of seven lines of eight words, of which no two lines reach 20 words, in rows that are repeated."""
    line = lambda who, k: " ".join(f"{who}{k}x{j}" for j in range(8))
    passage = "\n".join(line("p", k) for k in range(7))
    other = "\n".join(line("q", k) for k in range(7))
    repeated = f"{line('b', 0)}\n{passage}\n{line('b', 1)}\n{other}"
    rows = [(1, f"{line('a', 0)}\n{passage}"), (2, repeated), (2, repeated), (2, repeated), (3, f"{other}\n{line('c', 0)}"), (None, other), (None, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.text, r.n_removed, r.runs_removed) for r in op09_line_dedup.deduplicate_lines(docs).collect()), key=str)
    # a null id comes first in the order
    cut = (2, f"{line('b', 0)}\n{line('b', 1)}", 14, 2)
    want = [(1, rows[0][1], 0, 0), cut, cut, cut, (3, line("c", 0), 7, 1), (None, other, 0, 0), (None, other, 0, 0)]
    assert got == sorted(want, key=str)
