"""Mail texts: boxes at every split size, parts at every depth."""

import email
import email.policy
import re

import pytest
from pyspark.sql import functions as F

from satchel.functions import text
from satchel.operators import mime
from satchel.sources import mail, sinks


@pytest.fixture
def split_size(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"]
    before = {n: spark.conf.get(n, None) for n in names}

    def to(size: int) -> None:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        spark.conf.set("spark.sql.files.minPartitionNum", 1)

    yield to
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_box_at_every_split(spark, tmp_path, split_size):
    bodies = ["a", "", "From me\n>From you\n>>From all", "x\n\nFrom y\nz", "long " * 50, "\u00e9\u4e2d\U0001f600" * 9, "ends\r\n", "no From here", "\nFrom", "Fro\nm "]
    mails = [f"X-Id: {i}\r\nSubject: s\r\n\r\n{b}" for i, b in enumerate(bodies)]
    df = spark.createDataFrame([("one.mbox", i, m) for i, m in enumerate(mails)], "out_name string, ord int, content string")
    sinks.write_combined(df.withColumn("content", sinks.mbox_entry(F.col("content"), F.lit(None).cast("timestamp"))), str(tmp_path / "parts"))
    assert sinks.merge_combined(spark, str(tmp_path / "parts"), str(tmp_path / "box")) == ["one.mbox"]
    size = (tmp_path / "box/one.mbox").stat().st_size
    want = [re.sub(r"(?<!\r)\n+\Z", "", m) for m in mails]
    for n in [*range(1, 30, 2), 61, 100, 257, size - 1, size]:
        split_size(n)
        rows = mail.read_mbox(spark, str(tmp_path / "box"), "*.mbox").orderBy("ord").collect()
        assert [r.text for r in rows] == want, n
        assert {r.separator for r in rows} == {"MAILER-DAEMON Thu, 01 Jan 1970 00:00:00 +0000"}


def test_foreign_box(spark, tmp_path):
    """A box of another program: blank lines between messages, one with the other line ends."""
    (tmp_path / "a").write_bytes(b"From a@b Thu Jan  1 00:00:00 1970\nA: 1\n\none\n\nFrom c@d\nA: 2\n\ntwo\n\n")
    (tmp_path / "b").write_bytes(b"From a@b\r\nA: 3\r\n\r\nthree\r\n\r\nFrom c@d\r\nA: 4\r\n\r\nfour\r\n")
    (tmp_path / "c").write_bytes(b"")
    rows = mail.parsed(mail.read_mbox(spark, str(tmp_path))).orderBy("file", "ord").collect()
    assert [(r.headers[0].value, r.body.strip(), r.separator.split(" ")[0]) for r in rows] == [("1", "one", "a@b"), ("2", "two", "c@d"), ("3", "three", "a@b"), ("4", "four", "c@d")]


def test_single_mails(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(b"Header1: Value1\r\nHeader2: Value2\r\n\r\nBody text.")
    (tmp_path / "b.EML").write_bytes(b"\r\nno headers")
    (tmp_path / "c.txt").write_bytes(b"A: b\n\nc")
    rows = mail.parsed(mail.read_eml(spark, str(tmp_path))).orderBy("file").collect()
    assert [([(h.name, h.value) for h in r.headers], r.body) for r in rows] == [([("Header1", "Value1"), ("Header2", "Value2")], "Body text."), ([], "no headers")]


def _tree(message, path=()):
    yield path, message.get_content_type(), None if message.is_multipart() else message.get_payload()
    if message.get_content_maintype() == "multipart":
        for i, part in enumerate(message.get_payload()):
            yield from _tree(part, (*path, i + 1))


def _nested(depth: int) -> str:
    body = "Content-Type: text/plain\r\n\r\nsay --b inside\r\n--bb\r\nlast"
    for i in range(depth):
        body = f'Content-Type: multipart/mixed; boundary="b{i}"\r\n\r\npre {i}\r\n--b{i}\r\nContent-Type: text/html\r\n\r\n<{i}>\r\n--b{i}\r\n{body}\r\n--b{i}--\r\n'
    return "Subject: s\r\n" + body


def test_parts_at_every_depth(spark):
    mails = [(i, _nested(i)) for i in (0, 1, 3, 25)]
    rows = mime.part_tree(spark.createDataFrame(mails, "id int, text string"), ["id"]).collect()
    for i, raw in mails:
        want = {(p, t, b) for p, t, b in _tree(email.message_from_string(raw, policy=email.policy.compat32))}
        got = {(tuple(r.path), r.content_type, r.body) for r in rows if r.id == i}
        assert got == want
    assert {r.preamble for r in rows if r.id == 3 and len(r.path) == 1 and r.body is None} == {"pre 1"} and not [r for r in rows if r.note]


def test_broken_parts(spark):
    head = "Content-Type: multipart/mixed; boundary=x.*\r\n\r\n"
    mails = {
        "open": head + "p\r\n--x.*\r\n\r\none\r\n--x.*\r\nA: b\r\n\r\ntwo", "none": "Content-Type: multipart/mixed\r\n\r\nbody", "empty": head, "missing": head + "only text",
        "adjacent": head + "--x.*\r\n--x.*--", "quote": "Content-Type: multipart/mixed; boundary=\"a\\\\Eb\"\n\n--a\\\\Eb\n\nin\n--a\\\\Eb--".replace("\\\\", "\\"),
    }
    rows = mime.part_tree(spark.createDataFrame([*mails.items(), ("null", None)], "id string, text string"), ["id"]).collect()
    found = {i: sorted(((tuple(r.path), r.body, r.preamble, r.epilogue, r.note) for r in rows if r.id == i), key=str) for i in [*mails, "null"]}
    assert found["open"] == [((), None, "p", None, "not closed"), ((1,), "one", None, None, None), ((2,), "two", None, None, None)]
    assert found["none"] == [((), "body", None, None, "no boundary")] and found["empty"] == [((), None, "", None, "not closed")] and found["missing"] == [((), None, "only text", None, "not closed")]
    assert found["adjacent"] == [((), None, "", "", None), ((1,), "", None, None, None)] and found["quote"] == [((), None, "", "", None), ((1,), "in", None, None, None)] and found["null"] == []


def test_drawn_tree(spark):
    parts = mime.part_tree(spark.createDataFrame([(1, _nested(1))], "id int, text string"), ["id"])
    assert [r.line for r in parts.orderBy("path").select(mime.tree_lines(parts).alias("line")).collect()] == ['- #<Mime content_type="multipart/mixed">', '  - #<Mime content_type="text/html">', '  - #<Mime content_type="text/plain">']
    assert spark.range(1).select(text.boundary_of(F.lit("multipart/x; Boundary = abc; c=d")).alias("b")).first().b == "abc"


def test_texts_are_cut_once(spark):
    """A level's plan has each search of a text once: for the empty line, the closing boundary and the boundaries."""
    from satchel.operators import mime

    raw = spark.createDataFrame([(1, [1], "x")], "k int, path array<int>, raw string")
    plan = mime._level(raw, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("--\\Q") == 2
