import datetime
import email
import random

import pytest
from pyspark.sql import functions as F

from satchel.dictionary import PS_MAPI, PSETID_ADDRESS, PS_PUBLIC_STRINGS
from satchel.plans import convert, folders
from satchel.sources import compound, msg, pst, sinks
from satchel.streaming import ingest

from . import fixtures as fx


def test_compound_round_trip():
    big, small = bytes(range(256)) * 40, b"tiny"
    root = compound.Entry("Root Entry", None, [compound.Entry("big", big), compound.Entry("dir", None, [compound.Entry("small", small), compound.Entry("empty", b"")]), *[compound.Entry(f"s{i}", bytes([i]) * (i * 97)) for i in range(60)]])
    back = compound.read(compound.write(root))
    assert back.child("big").data == big and back.child("dir").child("small").data == small and back.child("dir").child("empty").data == b""
    assert all(back.child(f"s{i}").data == bytes([i]) * (i * 97) for i in range(60))
    with pytest.raises(ValueError):
        compound.read(b"something else" * 100)


def test_message_rows():
    rows = list(msg.parse("m", fx.message_file()))
    own = {(r["code"], r["name"], r["guid"]): r for r in rows if r["owner"] == "message" and r["item_id"] == "m"}
    assert own[0x0037, None, PS_MAPI]["v_str"] == "Grüße" and own[0x1000, None, PS_MAPI]["v_str"] == "line\r\nFrom here"
    assert own[0x8005, None, PSETID_ADDRESS]["v_str"] == "filed" and own[None, "Keywords", PS_PUBLIC_STRINGS]["v_arr"] == ["one", "two"]
    assert own[0x0017, None, PS_MAPI]["v_int"] == -2 and own[0x0029, None, PS_MAPI]["v_bool"] is True
    assert own[0x0E06, None, PS_MAPI]["v_ts"] == datetime.datetime(1970, 1, 2, tzinfo=datetime.timezone.utc)
    assert {r["child_ix"] for r in rows if r["owner"] == "attachment"} == {0, 2}  # an attachment without properties is dropped
    assert [r["v_str"] for r in rows if r["item_id"] == "m/2" and r["code"] == 0x1000] == ["inner body"]


@pytest.mark.parametrize("version", [1997, 2003])
@pytest.mark.parametrize(("encode", "chain"), [(False, False), (True, True)])
def test_store(version, encode, chain):
    data = fx.store_file(version, encode, chain)
    store = pst.Store(data, fx.DECIPHER)
    assert store.version == version and [n[0] for n in store.nodes] == [0x21, 0x8022, 0x8042, 0x8062, 0x8082, 0x200024, 0x61]
    rows = list(pst.parser(fx.DECIPHER)("s", data))
    assert not [r for r in rows if r["owner"] == "error"]
    mail = {r["code"]: r for r in rows if r["item_id"] == str(0x200024) and r["owner"] == "message"}
    assert mail[0x0037]["v_str"] == "RE: x" and mail[0x0017]["v_int"] == -2 and mail[0x802B]["v_arr"] == ["one", "two!"]
    assert mail[0x0E06]["v_ts"] == datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)
    people = [(r["child_ix"], r["v_str"]) for r in rows if r["owner"] == "recipient" and r["code"] == 0x3001]
    assert people == [(0, "Ann"), (1, "Bob")]  # of a repeated sub-node id the first counts
    file = {r["code"]: r for r in rows if r["owner"] == "attachment"}
    assert file[0x3704]["v_str"] == "long name.txt" and file[0x3701]["v_bin"] == b"data"


def test_bad_stores():
    data = fx.store_file(1997)
    for bad in (b"", b"!BDN" + bytes(600), data[:-1], b"XXXX" + data[4:]):
        with pytest.raises((ValueError, IndexError)):
            pst.Store(bad)
    with pytest.raises(ValueError):
        pst.Store(fx.store_file(1997, encode=True))


def test_read_and_convert(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.msg").write_bytes(fx.message_file())
    (tmp_path / "in/c.MSG").write_bytes(fx.contact_file())
    (tmp_path / "in/bad.msg").write_bytes(b"nothing")
    (tmp_path / "in/s.pst").write_bytes(fx.store_file(2003))
    rows = msg.read(spark, str(tmp_path / "in")).unionByName(pst.read(spark, str(tmp_path / "in"))).cache()
    assert [r.file.rsplit("/")[-1] for r in rows.where("owner = 'error'").collect()] == ["bad.msg"]
    out = {(r.file.rsplit("/")[-1], r.item_id.rsplit("/")[-1]): r for r in convert.convert(rows).collect()}
    mail = out["a.msg", "a.msg"].content
    assert mail.startswith('From: s@example.com\r\nTo: "Ann" <r0@example.com>\r\nCc: "Bob" <r1@example.com>\r\nSubject: Grüße\r\nDate: Fri, 02 Jan 1970 00:00:00 +0000\r\n')
    assert "multipart/mixed" in mail and 'filename="a b.bin"' in mail and "line\r\nFrom here" in mail
    assert out["c.MSG", "c.MSG"].content == "BEGIN:VCARD\nVERSION:3.0\nN:Ex;Ann;;;\nFN:Ann Ex\nEND:VCARD\n"
    assert out["s.pst", str(0x200024)].kind == "eml"
    converted = convert.convert(rows)
    assert {r.file.rsplit("/")[-1]: r.folder for r in converted.collect()} == {"a.msg": None, "c.MSG": None, "s.pst": "Inbox/Lists"}
    convert.export_combined(converted, str(tmp_path / "out"))
    assert sinks.merge_combined(spark, str(tmp_path / "out"), str(tmp_path / "one")) == ["Contacts.vcf", "Mail.mbox"]
    box = (tmp_path / "one/Mail.mbox").read_text()
    assert box.count("\nFrom MAILER-DAEMON ") == 1 and box.startswith("From MAILER-DAEMON ") and "\n>From here" in box
    convert.export_combined(converted, str(tmp_path / "split"), F.col("folder"))
    assert sinks.merge_combined(spark, str(tmp_path / "split"), str(tmp_path / "apart")) == ["Contacts.vcf", "Inbox.Lists.mbox", "Mail.mbox"]
    assert convert.export_individual(converted, str(tmp_path / "each")) == 3
    assert (tmp_path / "each/Gr__e.eml").read_text(newline="") == mail and {p.name for p in (tmp_path / "each").iterdir()} == {"Gr__e.eml", "Ann_Ex.vcf", "RE__x.eml"}
    assert sinks.save_attachments(convert.attachments(rows), str(tmp_path / "files")) == 2
    assert (tmp_path / "files/a_b.bin").read_bytes() == bytes(range(256)) * 20 and (tmp_path / "files/long_name.txt").read_bytes() == b"data"


def test_embedded_messages(spark, tmp_path):
    """A message in a message in a message: each stands as mail in its attachment's part, and is no item of its own."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in/n.msg").write_bytes(fx.nested_file(3))
    out = convert.convert(msg.read(spark, str(tmp_path / "in"))).collect()
    assert len(out) == 1 and "\x00" not in out[0].content
    whole = email.message_from_string(out[0].content)
    for level in range(3):
        assert whole["Subject"] == f"level {level}" and whole.get_content_type() == "multipart/mixed"
        text, inner = whole.get_payload()
        assert text.get_payload().strip() == f"body {level}" and inner.get_content_type() == "message/rfc822" and inner.get_filename() == f"level {level + 1}"
        whole = inner.get_payload()[0]
    assert whole["Subject"] == "level 3" and whole.get_payload().strip() == "body 3"


def test_folders(spark, tmp_path):
    """Kinds and paths of a store's items, and conversion of one folder only."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in/s.pst").write_bytes(fx.store_file(2003))
    (tmp_path / "in/a.msg").write_bytes(fx.message_file())
    rows = msg.read(spark, str(tmp_path / "in")).unionByName(pst.read(spark, str(tmp_path / "in"))).cache()
    found = {int(r.item_id): (r.item_type, r.folder, r.name) for r in folders.paths(rows).collect()}
    assert found == {0x21: ("root", None, "Store"), 0x8022: ("folder", "", "Inbox"), 0x8042: ("folder", "", "Top"), 0x8062: ("wastebasket", "", "Deleted"), 0x8082: ("folder", "Inbox", "Lists"), 0x200024: ("message", "Inbox/Lists", None)}
    assert [r.item_id for r in convert.convert(rows, under="\\INBOX//").collect()] == [str(0x200024)]
    assert convert.convert(rows, under="Inb").count() == 0 and convert.convert(rows, under="Deleted").count() == 0


def test_stream(spark, tmp_path):
    """Files that arrive are parsed once, in any number of runs; a bad one is an error row."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.msg").write_bytes(fx.message_file())
    for more in ("s.pst", "bad.MSG"):
        ingest.append_rows(ingest.property_rows(spark, str(tmp_path / "in")), str(tmp_path / "table"), str(tmp_path / "state")).awaitTermination()
        (tmp_path / "in" / more).write_bytes(fx.store_file(1997) if more == "s.pst" else b"none")
    ingest.append_rows(ingest.property_rows(spark, str(tmp_path / "in")), str(tmp_path / "table"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "table"))
    want = msg.read(spark, str(tmp_path / "in")).unionByName(pst.read(spark, str(tmp_path / "in")))
    assert got.count() == want.count() and got.where("owner = 'error'").count() == 1


def test_unique_names(spark):
    rows = spark.createDataFrame([(f"{i:03}", "a.eml" if i % 2 else None if i % 6 == 0 else "b.eml") for i in range(60)], "o string, n string")
    plain = {r.o: r.filename for r in sinks.unique_filenames(rows, "n", "o").collect()}
    assert [plain[f"{i:03}"] for i in (1, 3, 5)] == ["a.eml", "a.2.eml", "a.3.eml"]
    dealt = sinks.unique_filenames(rows, "n", "o", hot_rows=10).where("n = 'a.eml'").collect()
    assert {r.filename for r in dealt} == {"a.eml", *(f"a.{i}.eml" for i in range(2, 31))}


def _first_free(rows, taken=()):
    """What the numbering means, row by row."""
    used, out, by = set(taken) | {n for _, n in rows if n is not None}, {}, set(taken)
    for o, n in sorted(rows):
        if n is None:
            out[o] = None
        elif n not in by:
            by.add(n)
            out[o] = n
        else:
            stem, dot, end = (n.rpartition(".") if n.rpartition(".")[2] and "." in n else (n, "", ""))
            k = 2
            while (name := f"{stem}.{k}{dot}{end}") in used:
                k += 1
            used.add(name)
            out[o] = name
    return out


def test_names_that_look_numbered(spark):
    """Names that are numbered by themselves are nobody else's; what is in the folder already counts as well."""
    rng = random.Random(5)
    pool = ["a.eml", "a.2.eml", "a.3.eml", "a.5.eml", "a.2.2.eml", "a", "a.2", "a.3", "a.", "a..2", ".eml", ".2.eml", "b.02.eml", "b.eml", "b.1.eml", "c.9999999999999999999.eml", "c.eml", "a.2.3", "", None]
    for hot, taken in ((100, []), (4, ["a.eml", "a.4.eml", "b.eml", "x"]), (3, ["a.2.eml", "a.3", ""])):
        rows = [(f"{i:03}", rng.choice(pool)) for i in range(150)]
        df = spark.createDataFrame(rows, "o string, n string")
        got = {r.o: r.filename for r in sinks.unique_filenames(df, "n", "o", hot_rows=hot, taken=spark.createDataFrame([(x,) for x in taken], "filename string")).collect()}
        names = [x for x in got.values() if x is not None]
        assert len(got) == 150 and len(set(names)) == len(names) and not set(names) & set(taken)
        if hot == 100:  # numbers follow the order of rows, where a name isn't dealt out
            assert got == _first_free(rows, taken)
        else:
            assert sorted(names) == sorted(x for x in _first_free(rows, taken).values() if x is not None)
    three = spark.createDataFrame([("1", "a.eml"), ("2", "a.eml"), ("3", "a.2.eml")], "o string, n string")
    assert {r.filename for r in sinks.unique_filenames(three, "n", "o").collect()} == {"a.eml", "a.2.eml", "a.3.eml"}
    assert sinks.unique_filenames(three.limit(0), "n", "o").count() == 0


def test_files_are_whole_or_not_there(spark, tmp_path):
    """Long subjects, names that clash with each other and with earlier files; a job that fails leaves nothing."""
    rows = [("f", str(i), "eml", s, None, None, f"text {i}") for i, s in enumerate(["x" * 300, "x" * 301, "a", "a", "a.2", "é" * 300])]
    converted = spark.createDataFrame(rows, "file string, item_id string, kind string, subject string, date timestamp, folder string, content string")
    out = tmp_path / "each"
    assert convert.export_individual(converted, str(out)) == 6 and len(list(out.iterdir())) == 6
    assert convert.export_individual(converted, str(out)) == 6 and len(list(out.iterdir())) == 12 and all(len(p.name) < 255 for p in out.iterdir())
    assert sorted(p.read_text() for p in out.iterdir()) == sorted([r[-1] for r in rows] * 2)
    bad = spark.range(40, numPartitions=4).selectExpr("concat('n', id) AS name", "CASE WHEN id = 39 THEN raise_error('broken') ELSE 'x' END AS content")
    with pytest.raises(Exception, match="broken"):
        sinks.write_files(bad, str(tmp_path / "failed"), "name", "content")
    # what a task that is being stopped still writes is in a folder of its own
    assert not (tmp_path / "failed").exists() or all(p.name.startswith("_staging-") for p in (tmp_path / "failed").iterdir())
    assert sinks.write_files(bad.limit(0), str(tmp_path / "none"), "name", "content") == 0
