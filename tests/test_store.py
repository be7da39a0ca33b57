import json
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from satchel import dictionary as names
from satchel import queries
from satchel.functions import binary, cipher, rtf, text
from satchel.operators import messages, properties, store, tree
from satchel.plans.synth import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _plain(rows):
    return sorted(json.dumps([None if v is None else v if isinstance(v, (bool, int, str)) else str(v) for v in r]) for r in rows)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert _plain(got.select(*columns).collect()) == _plain(want.fetchall())


def test_keys(spark):
    """The rendering and resolving of keys."""
    rows = [(1, 0, 0x0037, None, names.PS_MAPI, "the subject"), (1, 1, None, "Keywords", names.PS_PUBLIC_STRINGS, "some keywords"), (1, 2, 0x8888, None, names.PS_MAPI, "un-mapped value"), (1, 3, 0x8000, None, "00020328-0000-0000-c000-deadbeefcafe", "x"), (1, 4, 0x8005, None, names.PSETID_ADDRESS, "f")]
    df = spark.createDataFrame(rows, "item_id long, ord int, code int, name string, guid string, value string")
    named = properties.with_symbol(df, names.dictionary(spark))
    assert {r.ord: r.symbol for r in named.collect()} == {0: "subject", 1: "keywords", 2: None, 3: None, 4: "file_under"}
    shown = {r.ord: r.key for r in properties.key_text(names.namespaces(spark))(df).collect()}
    assert shown[0] == "0x0037" and shown[1] == '#<Key PS_PUBLIC_STRINGS/"Keywords">' and shown[3] == "#<Key {00020328-0000-0000-c000-deadbeefcafe}/0x8000>"
    assert names.PS_MAPI == "00020328-0000-0000-c000-000000000046" and len(names.NAMESPACES) == 14


def test_read_tags(spark, tmp_path):
    (tmp_path / "tags").write_text('--- \n66b0: \n- PR_RECIPIENT_ON_ASSOC_MSG_COUNT\n- PT_LONG\n"0061": \n- PR_END_DATE\n- PT_SYSTIME\n')
    assert names.read_tags(spark, str(tmp_path / "tags")) == {0x66B0: "recipient_on_assoc_msg_count", 0x61: "end_date"}


def test_vcard_golden(spark):
    """Expected card of a contact with all fields; the ADR line folds at 75 characters."""
    fields = {"subject": "full name", "given_name": "given name", "surname": "surname", "company_name": "company name", "file_under": "file under", "business_address_street": "business address street", "business_address_city": "business address city", "business_address_state": "business address state", "email_addr_type": "SMTP", "email_email_address": "email@address.com"}
    card = spark.range(1).select(messages.vcard({k: F.lit(v) for k, v in fields.items()}).alias("c")).first().c
    assert card == "BEGIN:VCARD\nVERSION:3.0\nN:surname;given name;;;\nFN:full name\nADR;TYPE=work:;;business address street;business address city\\, business ad\n dress state;;;\nX-EVOLUTION-FILE-AS:file under\nEMAIL:email@address.com\nORG:company name\nEND:VCARD\n"


def test_rtf_text():
    source = "{\\rtf1\\ansi\\fromtext{\\fonttbl\n\r{\\f0\\fswiss Arial;}}\r\n\\pard\\f0 \\par one \\{x\\}\\par caf\\'e9 \\b bold\\b0\\~y\\par}"
    assert rtf.to_text(source) == "\none {x}\ncafé bold y\n"
    assert rtf.to_text(source, html=True) == "<html>\n<body>\n<br>one {x}\n<br>café <b>bold</b> y\n<br></body>\n</html>\n"
    assert rtf.embedded_html(source) is None
    tagged = "{\\rtf1\\fromhtml1 {\\*\\htmltag64 <p>}\\htmlrtf {\\b \\htmlrtf0 hi{\\*\\mhtmltag84 <a m>}{\\*\\htmltag84 <a>}\\'e9\\par {\\*\\htmltag72 </p>}}"
    assert rtf.embedded_html(tagged) == "<p>hi<a m>é\r\n</p>"


def test_rtf_reading_rules():
    """Groups, destinations, Unicode escapes with their fallback, code pages, raw data."""
    assert rtf.to_text(r"{\rtf1{\b in {\i group}} out{\*\unknown gone{\b too}}{\info{\title gone}}{\pict\bin3 }}}x}!") == "in group out!"
    assert rtf.to_text(r"{\rtf1\uc1 @8364?@-10179?{\uc2@228\'e4\'e4}@960 ?z\~\_\-}".replace("@", "\\u")) == "€�äπz -"
    assert rtf.to_text(r"{\rtf1\ansicpg1251 \'cf\'f0{\lquote a\rquote\ldblquote b\rdblquote\endash}}") == "Пр'a'\"b\"-"
    assert rtf.to_text(r"{\rtf1 a}} b", html=True) == "<html>\n<body>a b</body>\n</html>\n" and rtf.to_text("") == ""
    assert rtf.to_text(r"{\rtf1 {\rtlch\fcs1 \af0 {\b x<{\i y}}}}", html=True) == "<html>\n<body><b>x&lt;</b><b><i>y</i></b></body>\n</html>\n"
    assert rtf.embedded_html(r"{\rtf1\fromhtml1{\*\htmltag19 <html>}{\pntext\f0 1.}\htmlrtf\par\htmlrtf0 a\line{\*\htmltag241 <b>}{\b c\htmlrtf d\htmlrtf0}}") == "<html>a\r\n<b>c"
    assert rtf.embedded_html(r"{\rtf1\fromhtml1{\*\htmltag19  }}") is None


def test_rtf_golden():
    """The expected texts of an out-of-office message, from packed and from stored RTF."""
    lines = ["I will be out of the office starting  15.02.2007 and will not return until", "27.02.2007.", "", "I will respond to your message when I return."]
    head = [r"{\rtf1\ansi\ansicpg1252\fromtext \deff0{\fonttbl", r"{\f0\fswiss Arial;}", r"{\f2\fnil\fcharset2 Symbol;}}", r"{\colortbl\red0\green0\blue0;\red0\green0\blue255;}", r"\uc1\pard\plain\deftab360 \f0\fs20 \par"]
    source = "\n\r".join([*head, *(x + r"\par" for x in lines), "}"])
    for stored in (False, True):
        back = rtf.body_rtf(rtf.compress(source.encode(), stored))
        assert back == source and rtf.to_text(back) == "\n" + "".join(x + "\n" for x in lines)
        assert rtf.body_html(back) == "<html>\n<body>\n" + "".join("<br>" + x + "\n" for x in lines) + "<br></body>\n</html>\n"


def test_compressed_rtf():
    for plain in (b"", b"{\\rtf1 x}", b"abc" * 3000, bytes(range(1, 256)) * 40):
        assert rtf.decompress(rtf.compress(plain)) == plain and rtf.decompress(rtf.compress(plain, stored=True)) == plain
    # a hand-made stream: one literal, then a reference to "{\rtf1" at the start of the prefilled ring
    assert rtf.decompress(bytes.fromhex("0f000000" "07000000" "4c5a4675" "00000000" "02" "41" "0004")) == b"A{\\rtf1"
    assert rtf.body_rtf(b"nonsense nonsense nonsense") is None and rtf.body_rtf(None) is None
    with pytest.raises(ValueError):
        rtf.decompress(bytes(16))


def test_binary(spark):
    row = spark.sql("SELECT X'C3A9000100000080' AS b, X'280302000000000 0C000000000000046' AS g".replace("0 0", "00"))
    r = row.select(binary.le_uint(F.col("b")).alias("u"), binary.le_int32(F.lit(b"\xfe\xff\xff\xff")).alias("i"), binary.guid_text(F.col("g")).alias("g"), binary.filetime(F.lit(116444736000000010)).alias("t"), binary.metafile_size(F.lit(bytes.fromhex("d7cdc69a0000000000006400c8006400" + "00" * 6))).alias("m")).first()
    assert int(r.u) == 0x800000000100A9C3 and r.i == -2 and r.g == names.PS_MAPI and r.t.microsecond == 1 and (r.m.width, r.m.height) == (96, 192)
    assert cipher.inverse(cipher.inverse(bytes((i * 3) % 256 for i in range(256)))) == bytes((i * 3) % 256 for i in range(256))
    with pytest.raises(ValueError):
        cipher.inverse(bytes(256))


def test_headers(spark):
    raw = "A: 1\r\nb:\ttwo\r\n three\r\nA: 2\n\tmore\r\nnone\r\n\r\nbody\r\n\r\nrest"
    r = spark.range(1).select(text.parse_headers(text.header_block(F.lit(raw))).alias("h"), text.message_body(F.lit(raw)).alias("b"), text.fold(F.lit("x" * 160)).alias("f"), text.header_attributes(F.lit('a/b; x="1 2"; y=3; x=4')).alias("a")).first()
    assert [(h.name, h.value) for h in r.h] == [("A", "1"), ("b", "two three"), ("A", "2 more")] and r.b == "body\r\n\r\nrest"
    assert [len(x) for x in r.f.split("\n")] == [75, 75, 12] and r.a == {"x": "1 2", "y": "3"}


def test_mime_round_trip(spark):
    """A built multipart message splits into the parts it was built from."""
    r = spark.range(1).select(text.split_multipart(messages.joined_parts(F.lit("pre"), F.array(F.lit("one"), F.lit("two")), F.lit("=m")), F.lit("=m")).alias("p")).first().p
    assert (r.preamble, list(r.parts), r.epilogue) == ("pre", ["one", "two"], "")


def test_circular_and_large_trees(spark):
    """A circle through the root is walked once; circles elsewhere and deep chains are told apart; text ids do too."""
    circle = [("a", "d", 0, "A"), ("b", "a", 1, "B"), ("c", "b", 0, "C"), ("d", "c", 0, "D"), ("x", "y", 0, "X"), ("y", "x", 0, "Y")]
    nodes = spark.createDataFrame(circle, "node_id string, parent_id string, ord int, display_name string")
    walked = tree.walk(nodes, nodes.where("node_id = 'a'"))
    assert {(r.node_id, r.depth, r.path) for r in walked.collect()} == {("a", 0, ""), ("b", 1, ""), ("c", 2, "B"), ("d", 3, "B/C")}
    assert {r.node_id for r in tree.unreached(nodes, walked).collect()} == {"x", "y"}
    wide = spark.range(1, 1_200_001, numPartitions=4).selectExpr("id AS node_id", "0L AS parent_id", "0 AS ord", "'n' AS display_name").union(spark.sql("SELECT 0L, 0L, 0, 'root'"))
    assert tree.walk(wide, wide.where("node_id = 0")).count() == 1_200_001
    assert tree.preorder(wide, wide.where("node_id = 0"), tree.walk(wide, wide.where("node_id = 0"))).agg(F.countDistinct("place")).first()[0] == 1_200_001


def test_deep_tree(spark):
    """A chain of 10,000 levels with side branches and a circle beside it: no limit of depth, paths and order of all nodes."""
    n = 10_000
    rows = [(i, max(i - 1, 0), 1, f"{i % 7}") for i in range(n)] + [(n + i, i * 100, 0, "b") for i in range(50)] + [(n + 100, n + 101, 0, "x"), (n + 101, n + 100, 0, "y"), (n + 102, n + 101, 0, "z")]
    nodes = spark.createDataFrame(rows, "node_id long, parent_id long, ord int, display_name string")
    walked = tree.walk(nodes, nodes.where("node_id = 0")).cache()
    assert walked.count() == n + 50 and {r.node_id for r in tree.unreached(nodes, walked).collect()} == {n + 100, n + 101, n + 102}
    names = [f"{i % 7}" for i in range(n)]
    found = {r.node_id: (r.depth, r.path) for r in walked.where(f"node_id >= {n} OR node_id % 1000 = 999").collect()}
    assert all(found[i] == (i, "/".join(names[1:i])) for i in range(999, n, 1000)) and all(found[n + i] == (i * 100 + 1, "/".join(names[1 : i * 100 + 1])) for i in range(50))
    places = {r.node_id: r.place for r in tree.preorder(nodes, nodes.where("node_id = 0"), walked).collect()}
    want, place = {}, 0
    for i in range(n):
        want[i] = place = place + 1
        if i % 100 == 0 and i < 5000:
            want[n + i // 100] = place = place + 1
    assert places == want
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "1000000"


def test_several_roots(spark):
    rows = [("b", None, 1, "B"), ("a", "a", 0, "A"), ("c", "a", 5, None), ("d", "c", 0, ""), ("e", "d", 0, "E"), ("f", "missing", 0, "F"), ("g", "b", 0, "G"), ("h", "g", 0, "H"), (None, "b", 3, "N")]
    nodes = spark.createDataFrame(rows, "node_id string, parent_id string, ord int, display_name string")
    tops = nodes.where("node_id in ('a', 'b')")
    assert {(r.node_id, r.depth, r.path) for r in tree.walk(nodes, tops).collect() if r.node_id} == {("a", 0, ""), ("b", 0, ""), ("c", 1, ""), ("d", 2, ""), ("e", 3, ""), ("g", 1, ""), ("h", 2, "G")}
    order = sorted((r.place, r.node_id) for r in tree.preorder(nodes.where("node_id is not null"), tops).collect())
    assert [x for _, x in order] == ["a", "c", "d", "e", "b", "g", "h"]


def test_empty_tables(spark):
    nodes = spark.createDataFrame([], "node_id long, parent_id long, ord int, display_name string")
    assert tree.orphans(nodes).count() == 0 and tree.children(nodes).count() == 0 and tree.walk(nodes, nodes).count() == 0
    ranges = spark.createDataFrame([], "file_id long, offset long, size long")
    assert store.range_gaps(ranges).count() == 0


def test_compression_time():
    """A text without repeats is compressed in a time that follows its length, not its length times the ring's."""
    import random
    import time

    plain = random.Random(4).randbytes(300_000)
    begun = time.process_time()
    packed = rtf.compress(plain)
    assert time.process_time() - begun < 2.5 and rtf.decompress(packed) == plain
    repeats = rtf.compress(b"one two three " * 1000)
    assert len(repeats) < 3000 and rtf.decompress(repeats) == b"one two three " * 1000


def test_cipher_columns(spark):
    """All bytes by Spark expressions, without Python workers."""
    table = bytes((i * 167 + 41) % 256 for i in range(256))
    rows = [(0, bytearray(range(256)) * 3), (1, bytearray()), (2, None), (3, bytearray([table.index(0)] * 5)), (4, bytearray(b"\x00\x00a"))]
    out = spark.createDataFrame(rows, "k int, b binary").select("k", "b", cipher.substitute(F.col("b"), table).alias("c"))
    out = out.withColumn("back", cipher.substitute(F.col("c"), cipher.inverse(table)))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        assert r.c == (None if r.b is None else bytes(r.b).translate(table)) and r.back == r.b
