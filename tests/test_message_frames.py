"""Message files as relations, against the reader that takes a file apart in memory."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from satchel.plans import convert
from satchel.sources import message_frames, msg
from satchel.sources.compound import Entry, write
from satchel.sources.rows import SCHEMA, parse_files

from . import fixtures as fx


def _files(spark, stores):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in stores.items()], "path string, content binary")


def _plain(df):
    """Rows without their place, which follows the directory in one reader and names in the other."""
    return sorted(str(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r)) for r in df.select(*[c for c in SCHEMA.fieldNames() if c != "ord"]).collect())


def _large() -> bytes:
    """Streams of many sizes, so that chains of both kinds are long."""
    rng = random.Random(8)
    sizes = [0, 1, 63, 64, 65, 511, 512, 4095, 4096, 4097, 9000, 70_000]
    return write(Entry("Root Entry", None, [fx.stream(0x6000 + i, 0x0102, rng.randbytes(n)) for i, n in enumerate(sizes)] + [fx.stream(0x001A, 0x1F, fx.utf16("IPM.Note")), fx.fixed(pad=8)]))


def test_same_rows_as_in_memory(spark):
    files = _files(spark, {"a": fx.message_file(), "n": fx.nested_file(12), "c": fx.contact_file(), "l": _large()})
    rows, notes = message_frames.property_rows(files)
    rows = rows.cache()
    want = parse_files(files, msg.parse)
    assert _plain(rows) == _plain(want) and notes.count() == 0
    assert {r.file: r.content for r in convert.convert(rows).collect()} == {r.file: r.content for r in convert.convert(want).collect()}


def test_faults(spark):
    good = fx.message_file()
    (fat,) = struct.unpack_from("<I", good, 76)
    (start,) = (struct.unpack_from("<I", good, 512 * (1 + s) + 128 * k + 116)[0] for s in range(len(good) // 512 - 1) for k in range(4) if good[512 * (1 + s) + 128 * k :][:40] == fx.utf16("__substg1.0_37010102"))
    at = 512 * (1 + fat) + 4 * start
    wild = write(Entry("Root Entry", None, [fx.stream(0x8001, 0x101F, fx.utf16("one"), 0xFFFFFFF), fx.stream(0x0037, 0x1F, fx.utf16("s")), fx.stream(0x1000, 0x1F, b"\x00\xd8a\x00b"), Entry("odd", b"x")]))
    stores = {
        "good": good, "signature": b"x" + good[1:], "empty": b"", "short": good[:600], "circle": good[:at] + struct.pack("<I", start) + good[at + 4 :], "sector": good[:30] + b"\x03\x00" + good[32:], "wild": wild,
    }
    rows, notes = message_frames.property_rows(_files(spark, stores))
    rows, notes = rows.cache(), {(r.file, r.code) for r in notes.collect()}
    assert _plain(rows.where("file = 'good'")) == _plain(parse_files(_files(spark, {"good": good}), msg.parse))
    assert {r.file for r in rows.where("owner = 'error'").collect()} == {"signature", "empty", "sector"}
    assert {("signature", "signature"), ("sector", "sector size"), ("circle", "short read"), ("wild", "bad multi-value"), ("wild", "unknown entry")} <= notes and not {n for n in notes if n[0] == "good"}
    assert {(r.code, r.v_str) for r in rows.where("file = 'wild'").collect()} == {(0x37, "s"), (0x1000, "�ab".replace("b", "") + "�")}
    data = [r.v_bin for r in rows.where(f"file = 'circle' and code = {0x3701}").collect()]
    assert all(len(x or b"") < 5120 for x in data)
    with pytest.raises(Exception, match="broken rules"):
        message_frames.property_rows(_files(spark, {"e": b""}), mode="fail")


def test_chains(spark):
    """Chains by slices and, where two run into one another, by following; circles and links to nowhere."""
    end = 0xFFFFFFFE
    tables = [[1, 2, end, end], [2, 2, 3, end, 1], [3, 0, end, 1, 1, 5, 9], [2, 2, end, 2], [], [end], [1, 0, 0]]
    rows = [(k, links, at) for k, links in enumerate(tables) for at in range(len(links) + 2)]
    out = message_frames._with_chains(spark.createDataFrame(rows, "k int, links array<long>, at long"), "links", "chains")
    for r in out.select("links", "at", message_frames._chain(F.col("at"), F.col("chains"), F.col("links")).alias("found")).collect():
        want, now = [], r["at"]
        while now < len(r.links) and now not in want:
            want.append(now)
            now = r.links[now] if r.links[now] != now else end
        assert r.found == ([] if now in want else want), r
