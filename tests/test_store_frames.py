"""Stores as relations, against the reader that takes a store apart in memory."""

import struct

import pytest
from pyspark.sql import functions as F

from satchel.operators import checks, store
from satchel.plans import convert
from satchel.sources import pst, store_frames
from satchel.sources.rows import SCHEMA, parse_files

from . import fixtures as fx


def _files(spark, **stores):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in stores.items()], "path string, content binary")


def _plain(df):
    return sorted(str(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r)) for r in df.select(*SCHEMA.fieldNames()).collect())


def test_same_rows_as_in_memory(spark):
    files = _files(spark, a=fx.store_file(1997), b=fx.store_file(2003), c=fx.store_file(2003, True, True), d=fx.store_file(1997, True, True))
    tables = store_frames.relations(files, fx.DECIPHER)
    got = store_frames.property_rows(tables)
    want = parse_files(files, pst.parser(fx.DECIPHER))
    assert _plain(got) == _plain(want)
    assert {r.code for r in tables.notes.rows(spark).collect()} == {"duplicate sub-node"}  # each fixture repeats one
    assert {r.file: r.content for r in convert.convert(got).collect()} == {r.file: r.content for r in convert.convert(want).collect()}


def _changed(data: bytes, at: int, new: bytes) -> bytes:
    return data[:at] + new + data[at + len(new) :]


def test_faults_are_notes(spark, monkeypatch):
    """Every fault has its note, and the rest of the store and all other stores are read. Segments are small, so that blocks span them."""
    monkeypatch.setattr(store_frames, "SEGMENT", 700)
    good, chained = fx.store_file(1997), fx.store_file(1997, chain=True)
    places = {i: (o, n) for i, o, n, _ in (struct.unpack_from("<IIHH", chained, 1024 + 12 * k) for k in range(chained[1024 + 0x1F0]))}
    at = {i: 1024 + 12 * k for k in range(chained[1024 + 0x1F0]) for i in [struct.unpack_from("<I", chained, 1024 + 12 * k)[0]]}
    stores = {
        "good": good, "signature": b"XXXX" + good[4:], "size": good + b"x", "kind": _changed(good, 0x0A, b"\x99"), "coded": fx.store_file(1997, encode=True), "empty": b"",
        "many": _changed(good, 1024 + 0x1F0, b"\x63"), "level": _changed(good, 2048 + 8, struct.pack("<I", 2048)), "start": _changed(good, 2048, struct.pack("<I", 0x99)), "far": _changed(good, 2048 + 8, struct.pack("<I", 1 << 30)),
        "circle": _changed(chained, places[34][0] + 8, struct.pack("<I", 34)), "depth": _changed(chained, places[34][0] + 1, b"\x02"), "short": _changed(chained, at[24] + 8, struct.pack("<H", 9000)), "lost": _changed(chained, at[8], struct.pack("<I", 9)),
        "heap": _changed(chained, places[40][0] + 2, b"\0\0"), "reference": _changed(chained, places[44][0] + 20, struct.pack("<I", 0x111)), "type": _changed(chained, places[44][0] + 18, b"\x77\x77"),
    }
    tables = store_frames.relations(_files(spark, **stores))
    rows = store_frames.property_rows(tables).cache()
    notes = {(r.file, r.code) for r in tables.notes.rows(spark).collect()} - {(f, "duplicate sub-node") for f in stores}
    assert {n for n in notes if n[0] in ("signature", "size", "kind", "coded")} == {("signature", "signature"), ("size", "size"), ("kind", "index type"), ("coded", "cipher")}
    want = {
        ("many", "too many records"), ("level", "bad level"), ("start", "wrong first id"), ("far", "short page"), ("circle", "circular chain"), ("short", "short read"), ("lost", "no block"),
        ("heap", "bad heap"), ("reference", "bad reference"), ("type", "unknown type"),
    }
    assert want <= notes and not {n for n in notes if n[0] in ("good", "depth")}
    errors = {(r.file, r.v_str.split(":")[0]) for r in rows.where("owner = 'error'").collect()}
    assert {("signature", "header"), ("size", "header"), ("empty", "header"), ("heap", "no property list"), ("circle", "no property list"), ("lost", "no property list")} <= errors
    alone = _plain(parse_files(_files(spark, good=good, depth=chained), pst.parser(None)))
    assert _plain(rows.where("file in ('good', 'depth')")) == alone
    name = {r.file: r.v_str for r in rows.where("item_id = '32898' and code = 12289").collect()}  # the folder whose reference and type were broken
    assert name["good"] == "Lists" and name["reference"] == "" and name["type"] is None
    with pytest.raises(Exception, match="broken rules: signature"):
        store_frames.relations(_files(spark, a=stores["signature"]), mode="fail")


def test_rules(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (None, "b"), (-1, "")], "n int, s string")
    good, bad, seen = checks.checked(rows, {"positive": F.col("n") > 0, "text": F.length("s") > 0})
    assert [tuple(r) for r in good.collect()] == [(1, "a")] and seen == {"positive": 2, "text": 2}
    assert sorted((str(r.n), r.broken) for r in bad.collect()) == [("-1", ["positive", "text"]), ("2", ["text"]), ("None", ["positive"])]
    assert checks.checked(rows.limit(0), {"positive": F.col("n") > 0})[2] == {"positive": 0} and checks.checked(rows, {})[0].count() == 4
    with pytest.raises(ValueError):
        checks.checked(rows, {}, "other")


def test_binary_values(spark):
    """Numbers, times and texts of bytes, at their edges."""
    from satchel.functions import binary

    doubles = [0.0, -0.0, 1.5, -2.25e300, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, float("inf"), float("-inf"), 0.1]
    rows = spark.createDataFrame([(d, bytearray(struct.pack("<d", d))) for d in doubles], "d double, b binary").select("d", binary.le_double(F.col("b")).alias("x")).collect()
    assert all(struct.pack("<d", r.d) == struct.pack("<d", r.x) for r in rows)
    texts = [b"", b"ab", b"ab\0", b"ab\0\0", "é".encode(), b"\xe9\x80", b"\x81\x93x\0", b"\xff"]
    wide = [b"", b"a\0", b"a", "aé\U0001f600z".encode("utf-16-le"), b"\x00\xd8a\0", b"\x00\xdca\0\x00\xd8", b"\x00\xd8\x00\xd8\x00\xdc", b"\xd8\x00\xdc\x00"]
    from satchel.sources.msg import text8

    got = spark.createDataFrame([(bytearray(t), bytearray(w)) for t, w in zip(texts, wide)], "t binary, w binary").select(binary.text8(F.col("t")).alias("t"), binary.utf16_text(F.col("w")).alias("w")).collect()
    assert [r.t for r in got] == [text8(t) for t in texts] and [r.w for r in got] == [w.decode("utf-16-le", "replace") for w in wide]
    odd = spark.createDataFrame([(bytearray(b"\xff\xff\xff\xff"),), (bytearray(b""),), (bytearray(struct.pack("<3I", 2, 12, 14) + b"abcd"),)], "b binary").select(binary.multi_value(F.col("b")).alias("m"), binary.heap_table(F.col("b"), F.lit(2).cast("long")).alias("h")).collect()
    assert [None if r.m is None else [bytes(x) for x in r.m] for r in odd] == [None, [], [b"ab", b"cd"]] and all(r.h is None for r in odd[:2])


def test_changes_to_absent_properties(spark):
    from satchel.operators import properties

    props = spark.createDataFrame([(1, 0, 1, None, "g", "a"), (1, 1, 2, None, "g", "b"), (1, 2, 1, None, "g", "c"), (2, 0, None, "n", "g", "d")], "item_id long, ord int, code int, name string, guid string, value string")
    changes = spark.createDataFrame([(1, 1, None, "g", 1, False, "x"), (1, 1, None, "g", 2, False, "y"), (1, 9, None, "g", 3, False, "new"), (2, None, "n", "g", 4, True, None), (3, 5, None, "g", 5, None, "other"), (3, 6, None, "g", 6, True, None)], "item_id long, code int, name string, guid string, change long, deleted boolean, value string")
    rows = lambda df: sorted(tuple(r) for r in df.select("item_id", "ord", "code", "value").collect())
    assert rows(properties.changed(props, changes)) == [(1, 0, 1, "y"), (1, 1, 2, "b"), (1, 2, 9, "new"), (3, 0, 5, "other")]
    assert rows(properties.changed(props, changes, absent="ignore")) == [(1, 0, 1, "y"), (1, 1, 2, "b")]
    assert rows(properties.changed(props, changes.limit(0))) == [(1, 0, 1, "c"), (1, 1, 2, "b"), (2, 0, None, "d")]
    with pytest.raises(Exception, match="no such property"):
        properties.changed(props, changes, absent="fail").collect()


def test_bounded_values(spark):
    rows = [(i, k, 4 if i != 2 or k else 6, n, bytearray(b"x" * n)) for i in range(3) for k, n in enumerate((3, 0, 5))] + [(9, 0, 4, 100, bytearray(100))]
    pieces = spark.createDataFrame(rows, "id int, place int, block_id long, size long, data binary")
    found = {r.id: (None if r.data is None else bytes(r.data), r.n_bytes, r.note) for r in store.concatenated(pieces, ["id"], 50).collect()}
    assert found == {0: (b"x" * 8, 8, None), 1: (b"x" * 8, 8, None), 2: (None, 8, "mixed encryption"), 9: (None, 100, "too long")}
