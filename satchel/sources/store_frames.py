"""PST stores as relations: header, index pages, blocks, nodes, chains, sub-node maps, heaps, property lists and tables, each a table
that the next is joined from. A file's bytes are cut into segments first, so that all further work on a large store is spread over
the cluster, and everything runs as Spark expressions, the cipher of encoded stores too.

    files -> segments, headers (format rules) -> index pages, level by level -> blocks, nodes
    internal blocks -> chain links, sub-node entries -> expanded chains and maps
    heaps of messages, recipients, attachments -> chunks -> slots -> references -> cells -> typed values

Written tables between the steps go to the shared folder (operators/scratch.py). `read` gives the property rows of sources/rows.py; notes
on what was odd are a second table. A store that breaks a rule of its header, and a page, block or heap that can't be read, give
notes and error rows; the others go on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dictionary import PS_MAPI
from ..functions import binary, cipher as ciphers, text
from ..operators import store
from ..operators.checks import Notes, checked
from ..operators.scratch import written, written_counting
from .rows import SCHEMA

#: Bytes of a segment, and of what a segment holds of the next one: a page or block (of under 64 KiB) lies in one row.
SEGMENT, OVERLAP = 1 << 20, 1 << 16
#: Values of more bytes stay pieces.
MOST_BYTES = 64 << 20
ATTACHMENTS, RECIPIENTS, ATTACHMENT_ID, SUBJECT = 0x671, 0x692, 0x67F2, 0x0037
HEAP = ["file", "node_id", "owner", "child_ix"]
le = binary.le_hex


def _by(wide: int, narrow: int) -> Column:
    return F.when(F.col("wide"), wide).otherwise(narrow)


def segments(files: DataFrame) -> DataFrame:
    """(file, seg, data): the bytes of files (path, content) in rows of about a megabyte."""
    count = F.greatest(F.ceil(F.octet_length("content") / SEGMENT).cast("int"), F.lit(1))
    rows = files.select(F.col("path").alias("file"), F.explode(F.sequence(F.lit(0), count - 1)).alias("seg"), "content")
    return rows.select("file", "seg", F.substring("content", F.col("seg") * SEGMENT + 1, F.lit(SEGMENT + OVERLAP)).alias("data"))


def headers(files: DataFrame) -> DataFrame:
    """(file, length, signature, kind, wide, encryption, size, node_root, block_root) from the first bytes of files."""
    h = F.hex(F.substring("content", F.lit(1), F.lit(1024)))
    out = files.select(F.col("path").alias("file"), F.octet_length("content").cast("long").alias("length"), h.alias("h"))
    out = out.withColumns({"signature": F.substring("h", 1, 8), "kind": le(F.col("h"), 0x0A, 1)}).withColumn("wide", F.coalesce(F.col("kind") == 0x17, F.lit(False)))
    word = lambda wide, narrow: F.when(F.col("wide"), le(F.col("h"), wide, 8)).otherwise(le(F.col("h"), narrow, 4))
    return out.select(
        "file", "length", "signature", "kind", "wide", le(F.col("h"), _by(0x201, 0x1CD), 1).alias("encryption"), word(0xB8, 0xA8).alias("size"),
        word(0xE0, 0xBC).alias("node_root"), word(0xF0, 0xC4).alias("block_root"),
    )


def header_rules(with_cipher: bool) -> dict[str, Column]:
    return {
        "signature": F.col("signature") == "2142444E", "index type": F.col("kind").isin(0x0E, 0x17), "encryption": F.col("encryption").isin(0, 1),
        "cipher": (F.col("encryption") != 1) | F.lit(with_cipher), "size": F.col("size") == F.col("length"),
    }


def index_records(heads: DataFrame, cut: DataFrame, notes: Notes) -> DataFrame:
    """The leaf records of both index trees of files: file, wide, tree (block or node), path (places from the root, which put records in
    the tree's order) and record (hexadecimal). heads: as headers() gives them.

    Pages are read level by level, those of all trees and files at once. A page's records end at an id of zero. Pages that are short,
    have too many records, don't start with the id by which they are listed, or aren't of a lower level than their parent are noted
    and left out, so a circle ends."""
    tree = F.explode(F.array(F.struct(F.lit("block").alias("tree"), F.col("block_root").alias("offset")), F.struct(F.lit("node").alias("tree"), F.col("node_root").alias("offset")))).alias("t")
    level = heads.select("file", "wide", tree).select("file", "wide", "t.tree", "t.offset", F.lit(None).cast("long").alias("start"), F.lit(256).cast("long").alias("above"), F.array().cast("array<int>").alias("path"))
    leaves = None
    while True:
        page = level.withColumn("seg", F.floor(F.col("offset") / SEGMENT).cast("int")).join(cut, ["file", "seg"], "left")
        page = page.withColumn("h", F.hex(F.substring("data", (F.col("offset") - F.col("seg") * SEGMENT + 1).cast("int"), F.lit(512)))).drop("data", "seg")
        page = page.withColumns({"count": le(F.col("h"), _by(0x1E8, 0x1F0), 1), "level": le(F.col("h"), _by(0x1EB, 0x1F3), 1)})
        leaf, block = F.col("level") == 0, F.col("tree") == "block"
        size = F.when(leaf, F.when(block, _by(24, 12)).otherwise(_by(32, 16))).otherwise(_by(24, 12))
        most = F.when(leaf, F.when(block, _by(20, 41)).otherwise(_by(15, 31))).otherwise(_by(20, 41))
        page = page.withColumns({"size": size, "most": most})
        records = F.when(F.col("count") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("count") - 1), lambda i: F.substring("h", (i * F.col("size") * 2 + 1).cast("int"), F.col("size") * 2))).otherwise(F.array().cast("array<string>"))
        first_id = lambda r: F.when(F.col("wide"), le(r, 0, 8)).otherwise(le(r, 0, 4))
        page = page.withColumn("records", F.when(F.col("count") <= F.col("most"), records))
        zero = F.array_position(F.transform("records", lambda r: F.coalesce(first_id(r), F.lit(-1))), F.lit(0).cast("long")).cast("int")
        page = page.withColumn("records", F.when(zero > 0, F.slice("records", 1, F.greatest(zero - 1, F.lit(0)))).otherwise(F.col("records")))
        note = (
            F.when(F.coalesce(F.length("h"), F.lit(0)) < 1024, "short page").when(F.col("count") > F.col("most"), "too many records").when(F.col("level") >= F.col("above"), "bad level")
            .when((F.size("records") > 0) & (first_id(F.get("records", F.lit(0))) != F.col("start")), "wrong first id")
        )
        page = page.withColumn("note", note).select("file", "wide", "tree", "offset", "path", "level", "note", "records")
        page, seen = written_counting(page, "pages", open="note is null and level > 0")
        notes.add(page, F.col("note"), F.concat("tree", F.lit(" page at "), "offset"))
        rows = page.where("note is null").select("file", "wide", "tree", "level", "path", F.posexplode("records").alias("at", "record")).withColumn("path", F.array_append("path", F.col("at"))).drop("at")
        own = rows.where("level = 0").drop("level")
        leaves = own if leaves is None else leaves.unionByName(own)
        if not seen["open"]:
            return leaves
        word = lambda wide, narrow: F.when(F.col("wide"), le(F.col("record"), wide, 8)).otherwise(le(F.col("record"), narrow, 4))
        level = rows.where("level > 0").select("file", "wide", "tree", word(16, 8).alias("offset"), word(0, 0).alias("start"), F.col("level").alias("above"), "path")


def blocks_and_nodes(records: DataFrame, notes: Notes) -> tuple[DataFrame, DataFrame]:
    """(file, block_id, offset, size) and (file, node_id, data_block, sub_block, parent_id, ord) of index records; of a repeated id the
    last counts, at the place of the first, and is noted."""
    word = lambda wide, narrow, n=None: F.when(F.col("wide"), le(F.col("record"), wide, n or 8)).otherwise(le(F.col("record"), narrow, n or 4))
    rows = records.where("tree = 'block'").select("file", "path", word(0, 0).alias("block_id"), word(8, 4).alias("offset"), word(16, 8, 2).alias("size"))
    last = F.max_by(F.struct("offset", "size"), "path").alias("x")
    blocks = written(rows.groupBy("file", "block_id").agg(last, F.count(F.lit(1)).alias("copies")).select("file", "block_id", "x.offset", "x.size", "copies"), "blocks")
    rows = records.where("tree = 'node'").select("file", "path", word(0, 0).alias("node_id"), word(8, 4).alias("data_block"), word(16, 8).alias("sub_block"), word(24, 12, 4).alias("parent_id"))
    last = F.max_by(F.struct("data_block", "sub_block", "parent_id"), "path").alias("x")
    nodes = written(rows.groupBy("file", "node_id").agg(last, F.min("path").alias("ord"), F.count(F.lit(1)).alias("copies")).select("file", "node_id", "x.data_block", "x.sub_block", "x.parent_id", "ord", "copies"), "nodes")
    notes.add(blocks, F.when(F.col("copies") > 1, "duplicate block"), F.col("block_id"))
    notes.add(nodes, F.when(F.col("copies") > 1, "duplicate node"), F.col("node_id"), F.col("node_id"))
    return blocks.drop("copies"), nodes.drop("copies")


@dataclass
class Relations:
    """The tables of stores: heads (of those whose header is good), bad heads, segments, blocks, nodes, notes; then chain links and the
    sub-node maps of the nodes, which follow from the blocks."""

    heads: DataFrame
    bad: DataFrame
    cut: DataFrame
    blocks: DataFrame
    nodes: DataFrame
    notes: Notes
    cipher: bytes | None = None
    links: DataFrame | None = None
    maps: DataFrame | None = None

    def fetch(self, refs: DataFrame) -> DataFrame:
        """refs (file, block_id, ...) with wide, size, data and note: the decoded bytes of blocks, by two joins. A block that isn't there
        or is cut short by the file's end is noted."""
        out = refs.join(self.blocks, ["file", "block_id"], "left").withColumn("seg", F.floor(F.col("offset") / SEGMENT).cast("int"))
        out = out.join(self.cut, ["file", "seg"], "left").join(self.heads.select("file", "wide", "encryption"), "file")
        out = out.withColumn("data", F.substring("data", (F.col("offset") - F.col("seg") * SEGMENT + 1).cast("int"), F.col("size").cast("int"))).drop("seg")
        note = F.when(F.col("offset").isNull(), "no block").when(F.coalesce(F.octet_length("data"), F.lit(0)) < F.col("size"), "short read")
        out = out.withColumn("note", note).drop("offset")
        if self.cipher is not None:
            coded = (F.col("encryption") == 1) & (F.col("block_id").bitwiseAND(F.lit(2)) == 0)
            out = out.withColumn("data", F.when(coded, ciphers.substitute(F.col("data"), self.cipher)).otherwise(F.col("data")))
        return out.drop("encryption")

    def chunks(self, heads: DataFrame, keys: list[str]) -> DataFrame:
        """The data blocks behind the head blocks of heads (keys with file, head_block), in order: keys, place, block_id, wide, size, data."""
        ids = heads.select("file", F.col("head_block").alias("head_id")).distinct()
        chains = written(store.expand_chains(ids, self.links, ["file"], circles=True), "chains")
        self.notes.add(chains, F.when(F.col("circle"), "circular chain"), F.col("head_id"))
        placed = heads.join(chains.where("not circle").drop("circle").withColumnRenamed("head_id", "head_block"), ["file", "head_block"])
        found = written(self.fetch(placed.select(*keys, "place", "block_id")), "chunks")
        self.notes.add(found, F.col("note"), F.col("block_id"), F.col("node_id") if "node_id" in keys else None)
        return found


def relations(files: DataFrame, cipher: bytes | None = None, mode: str = "quarantine") -> Relations:
    """The tables of stores. files: path, content. mode `fail`: a header that breaks a rule ends the job."""
    notes = Notes()
    cut = written(segments(files), "segments")
    heads, bad, _ = checked(headers(files), header_rules(cipher is not None), mode, "headers")
    notes.add(bad, F.array_join("broken", ", "), "header")
    blocks, nodes = blocks_and_nodes(index_records(heads, cut, notes), notes)
    tables = Relations(heads, bad, cut, blocks, nodes, notes, cipher)
    inner = tables.fetch(blocks.where(F.col("block_id").bitwiseAND(F.lit(2)) != 0).select("file", "block_id")).withColumn("h", F.hex("data"))
    kind = store.block_kind(F.col("block_id"), le(F.col("h"), 0, 1))
    inner = written(inner.select("file", "block_id", "wide", "h", "note", kind.alias("kind"), le(F.col("h"), 1, 1).alias("depth"), le(F.col("h"), 2, 2).alias("count")), "internal")
    notes.add(inner, F.coalesce("note", F.when(F.col("kind") == "unknown", "unknown block")), F.col("block_id"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("place")
    listed = lambda kind, *more: inner.where((F.col("kind") == kind) & (F.col("count") > 0)).select("file", "block_id", "wide", "h", *more, each)
    word = lambda at, n=None: F.when(F.col("wide"), le(F.col("h"), at, n or 8)).otherwise(le(F.col("h"), at, n or 4))
    tables.links = listed("chain").select("file", "block_id", "place", word(8 + F.col("place") * _by(8, 4)).alias("child_id")).where("child_id is not null")
    at = F.when(F.col("wide"), 8 + F.col("place") * 24).otherwise(4 + F.col("place") * 12)
    entries = listed("submap").select("file", F.col("block_id").alias("owner"), F.col("place").alias("ord"), le(F.col("h"), at, 4).alias("id2"), word(at + _by(8, 4)).alias("block_id"), word(at + _by(16, 8)).alias("nested")).where("nested is not null")
    roots = nodes.where("sub_block <> 0").select("file", F.col("sub_block").alias("owner"))
    maps = store.expand_submaps(roots, entries.distinct(), ["file"])
    tables.maps = written(maps.groupBy("file", "owner", "id2").agg(F.min_by("block_id", "ord").alias("block_id"), F.count(F.lit(1)).alias("copies")), "maps")
    notes.add(tables.maps, F.when(F.col("copies") > 1, "duplicate sub-node"), F.col("id2"))
    return tables


def _sub_values(tables: Relations, refs: DataFrame, most_bytes: int) -> DataFrame:
    """(file, owner_map, id2, data, note) of the sub-nodes that refs (file, owner_map, id2) name."""
    wanted = refs.select("file", "owner_map", "id2").distinct()
    there = wanted.join(tables.maps.select("file", F.col("owner").alias("owner_map"), "id2", F.col("block_id").alias("head_block")), ["file", "owner_map", "id2"])
    pieces = tables.chunks(there, ["file", "owner_map", "id2"])
    return written(store.concatenated(pieces, ["file", "owner_map", "id2"], most_bytes), "sub-values")


def _resolved(tables: Relations, refs: DataFrame, slots: DataFrame, name: str, most_bytes: int) -> DataFrame:
    """refs (heap keys, owner_map, ref, ...) with data and note, from the heap's slots or the sub-nodes."""
    inside, seen = written_counting(store.dereference(refs, slots, HEAP), name, sub="kind = 'subnode'")
    if seen["sub"]:
        subs = _sub_values(tables, inside.where("kind = 'subnode'").select("file", "owner_map", F.col("ref").alias("id2")), most_bytes)
        subs = subs.select("file", "owner_map", F.col("id2").alias("ref"), F.col("data").alias("_data"), F.col("note").alias("_note"), F.lit(True).alias("_there"))
        joined = inside.join(subs, ["file", "owner_map", "ref"], "left")
        sub = F.col("kind") == "subnode"
        joined = joined.withColumn("data", F.when(sub, F.when(F.col("_there"), F.col("_data")).otherwise(F.lit(b""))).otherwise(F.col("data")))
        inside = written(joined.withColumn("note", F.when(sub, F.when(F.col("_there"), F.col("_note")).otherwise("no sub-node")).otherwise(F.col("note"))).drop("_data", "_note", "_there"), name)
    tables.notes.add(inside, F.col("note"), F.col("ref"), F.col("node_id"))
    return inside


#: Types whose values are numbers in place; the others lead to bytes. Codes of property types.
IMMEDIATE = [0x0001, 0x0002, 0x0003, 0x000A, 0x000B]
KNOWN = [*IMMEDIATE, 0x0005, 0x000D, 0x0014, 0x001E, 0x001F, 0x0040, 0x0048, 0x0102, 0x101E, 0x101F, 0x1102]
_LAST_TICKS = 2650467744000000000  # the year 9999 ends


def typed(code: Column, kind: Column, raw: Column, data: Column) -> dict[str, Column]:
    """The value columns of properties by one CASE over type codes: raw numbers of types that stand in place, the bytes of others."""
    size, there = F.octet_length(data), data.isNotNull()
    string = F.when(kind == 0x001E, binary.text8(data)).when(kind == 0x001F, binary.utf16_text(data))
    string = F.when(code == SUBJECT, text.subject_without_prefix(string)).otherwise(string)
    ticks = binary.le_long(data)
    number = (
        F.when(kind == 0x0002, F.when(raw % 65536 >= 32768, raw % 65536 - 65536).otherwise(raw % 65536)).when(kind.isin(0x0003, 0x000A), F.when(raw >= 1 << 31, raw - (1 << 32)).otherwise(raw))
        .when((kind == 0x0014) & (size == 8), ticks)
    )
    pieces = binary.multi_value(data)
    listed = kind.isin(0x101E, 0x101F) & (size >= 4)
    whole = there & ~kind.isin(*IMMEDIATE, 0x001E, 0x001F) & ~(kind.isin(0x0005, 0x0014, 0x0040) & (size == 8)) & ~(kind.isin(0x101E, 0x101F, 0x1102) & (size >= 4))
    return {
        "v_str": string, "v_int": number, "v_dbl": F.when((kind == 0x0005) & (size == 8), binary.le_double(data)), "v_bool": F.when(kind == 0x000B, raw != 0),
        "v_ts": F.when((kind == 0x0040) & (size == 8) & ticks.between(0, _LAST_TICKS), binary.filetime(ticks)), "v_bin": F.when(whole, data),
        "v_arr": F.when(listed, F.transform(pieces, lambda p: F.when(kind == 0x101F, binary.utf16_text(p)).otherwise(binary.text8(p)))),
        "v_arr_bin": F.when((kind == 0x1102) & (size >= 4), pieces),
    }


def heap_values(tables: Relations, heaps: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The typed properties of heaps (file, node_id, owner, child_ix, head_block, owner_map): those of property lists, and of tables
    row by row (child_ix is the row then), with raw, ord, code and ptype. Heaps that are neither are noted as `bad heap`."""
    chunks = tables.chunks(heaps.select(*HEAP, "head_block"), HEAP).drop("note", "size")
    h = F.hex("data")
    table = F.posexplode(binary.heap_table(F.col("data"), le(h, 0, 2))).alias("slot", "range")
    slots = chunks.select(*HEAP, "place", "data", table)
    value = F.when(F.col("range.from") <= F.col("range.to"), F.substring("data", F.col("range.from") + 1, F.col("range.to") - F.col("range.from"))).otherwise(F.lit(b""))
    slots = written(slots.select(*HEAP, "place", "slot", value.alias("value")), "slots")
    own = heaps.select(*HEAP, "owner_map")
    first = chunks.where("place = 0").select(*HEAP, "wide", le(h, 2, 2).alias("sig"), le(h, 4, 4).alias("ref")).join(own, HEAP)
    first = _resolved(tables, first, slots, "heap-heads", most_bytes)
    x = F.hex("data")
    # property lists: a signature and the reference of their entries; tables: sizes, references and the descriptors of columns
    lists = (F.col("sig") == 0xBCEC) & (le(x, 0, 4) == 0x000602B5)
    n_columns = F.floor((F.octet_length("data") - 22) / 8)
    grids = (F.col("sig") == 0x7CEC) & (F.octet_length("data") >= 22) & (le(x, 0, 1) == 0x7C) & (le(x, 1, 1) == n_columns) & (le(x, 8, 2) > 0)
    first = first.withColumn("form", F.when(lists, "list").when(grids, "table"))
    tables.notes.add(first, F.when(F.col("form").isNull(), "bad heap"), F.format_string("0x%04x", "sig"), F.col("node_id"))
    refs = first.where("form is not null").select(*HEAP, "owner_map", "wide", "form", F.when(F.col("form") == "table", le(x, 8, 2)).cast("int").alias("rec_size"), F.explode(
        F.when(F.col("form") == "list", F.array(F.struct(F.lit("entries").alias("what"), le(x, 4, 4).alias("ref")))).otherwise(F.array(F.struct(F.lit("index").alias("what"), le(x, 10, 4).alias("ref")), F.struct(F.lit("rows").alias("what"), le(x, 14, 4).alias("ref"))))
    ).alias("r")).select(*HEAP, "owner_map", "wide", "form", "rec_size", "r.what", "r.ref")
    second = _resolved(tables, refs, slots, "heap-parts", most_bytes)
    y = F.hex("data")
    expected = F.when(F.col("wide"), 0x000404B5).otherwise(0x000204B5)
    odd = second.where((F.col("what") == "index") & ~F.coalesce(le(y, 0, 4) == expected, F.lit(False)))
    tables.notes.add(odd, "unknown table index", F.substring(y, 1, 8), F.col("node_id"))
    entries = second.where("what = 'entries' and octet_length(data) >= 8").select(*HEAP, "owner_map", y.alias("y"), F.explode(F.sequence(F.lit(0), F.floor(F.octet_length("data") / 8).cast("int") - 1)).alias("ord"))
    number = lambda at, n: le(F.col("y"), F.col("ord") * 8 + at, n)
    entries = entries.select(*HEAP, "owner_map", F.col("child_ix").alias("row"), "ord", number(0, 2).cast("int").alias("code"), number(2, 2).cast("int").alias("ptype"), number(4, 4).alias("raw"), F.lit(None).cast("binary").alias("cell"))
    # a table's rows: in one slot, or in the blocks of a sub-node, each of which holds whole rows
    good = second.where("what = 'rows'").join(odd.select(*HEAP), HEAP, "left_anti")
    held = good.where("kind <> 'subnode'").select(*HEAP, "owner_map", "rec_size", F.lit(0).alias("place"), "data")
    spread = good.where("kind = 'subnode'").select(*HEAP, "owner_map", "rec_size", F.col("ref").alias("id2"))
    spread = spread.join(tables.maps.select("file", F.col("owner").alias("owner_map"), "id2", F.col("block_id").alias("head_block")), ["file", "owner_map", "id2"])
    pieces = tables.chunks(spread.select(*HEAP, "head_block"), HEAP).select(*HEAP, "place", "data").join(spread.select(*HEAP, "owner_map", "rec_size"), HEAP)
    grid = held.unionByName(pieces.select(*held.columns))
    key = F.struct(*HEAP, "owner_map", "place")
    records = store.table_rows(grid.select(key.alias("table_id"), "data", "rec_size")).select("table_id.*", "row", "record")
    per = grid.groupBy(*HEAP, "place").agg(F.max(F.floor(F.octet_length("data") / F.col("rec_size"))).alias("n"))
    before = per.select(*HEAP, "place", (F.sum("n").over(store.Window.partitionBy(*HEAP).orderBy("place")) - F.col("n")).cast("int").alias("before"))
    records = records.join(before, [*HEAP, "place"]).withColumn("row", F.col("row") + F.col("before")).drop("before", "place")
    columns = store.column_descriptors(first.where("form = 'table'").select(*HEAP, F.expr("substring(data, 23, octet_length(data) - 22)").alias("schema")), HEAP)
    cells = store.cells(records, columns, HEAP).select(*HEAP, "owner_map", "row", F.col("column").alias("ord"), "code", F.col("ref_type").alias("ptype"), "raw", F.when(F.col("size") > 4, F.col("cell")).alias("cell"))
    found = entries.unionByName(cells)
    leads = ~F.col("ptype").isin(IMMEDIATE) & F.col("cell").isNull()
    found = _resolved(tables, found.withColumn("ref", F.when(leads, F.coalesce("raw", F.lit(0))).otherwise(0)), slots, "values", most_bytes)
    found = found.withColumn("data", F.when(leads, F.col("data")).otherwise(F.col("cell"))).drop("cell", "kind")
    tables.notes.add(found, F.when(~F.col("ptype").isin(KNOWN), "unknown type"), F.format_string("0x%04x", "ptype"), F.col("node_id"))
    # an object's bytes name the sub-node that holds it
    inner = F.when((F.col("ptype") == 0x000D) & (F.octet_length("data") >= 4), le(F.hex("data"), 0, 4))
    objects, seen = written_counting(found.withColumn("id2", inner), "objects", any="id2 is not null")
    if seen["any"]:
        subs = _sub_values(tables, objects.where("id2 is not null"), most_bytes).select("file", "owner_map", "id2", F.col("data").alias("_data"))
        objects = objects.join(subs, ["file", "owner_map", "id2"], "left").withColumn("data", F.coalesce("_data", "data")).drop("_data")
    return written(objects.drop("id2", "child_ix").withColumnRenamed("row", "child_ix").withColumns(typed(F.col("code"), F.col("ptype"), F.col("raw"), F.col("data"))).drop("data", "note", "ref"), "properties")


_KEY = ["file", "node_id", "child_ix"]


def property_rows(tables: Relations, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The property rows of stores, as sources/rows.py has them: messages and folders, recipients, and attachments with their own
    property lists laid over their table's rows; an error row for each store whose header is bad and each node without a list."""
    nodes = tables.nodes.where("data_block <> 0")
    message = nodes.select("file", "node_id", F.lit("message").alias("owner"), F.lit(-1).alias("child_ix"), F.col("data_block").alias("head_block"), F.col("sub_block").alias("owner_map"))
    by_map = nodes.select("file", "node_id", F.col("sub_block").alias("owner"))
    parts = tables.maps.where(F.col("id2").isin(RECIPIENTS, ATTACHMENTS)).join(by_map, ["file", "owner"])
    parts = parts.select("file", "node_id", F.when(F.col("id2") == RECIPIENTS, "recipient").otherwise("attachment").alias("owner"), F.lit(-1).alias("child_ix"), F.col("block_id").alias("head_block"), F.col("owner").alias("owner_map"))
    found = heap_values(tables, message.unionByName(parts), most_bytes)
    ids = found.where((F.col("owner") == "attachment") & (F.col("code") == ATTACHMENT_ID)).select("file", "node_id", F.lit("own").alias("owner"), "child_ix", "owner_map", F.col("raw").alias("id2"))
    lists = ids.join(tables.maps.select("file", F.col("owner").alias("owner_map"), "id2", F.col("block_id").alias("head_block")), ["file", "owner_map", "id2"]).select(*HEAP, "head_block", "owner_map")
    lists, seen = written_counting(lists, "attachment-lists", any="true")
    if seen["any"]:
        own = heap_values(tables, lists, most_bytes)
        both = found.where("owner = 'attachment'").withColumn("_rank", F.lit(0)).unionByName(own.withColumn("owner", F.lit("attachment")).withColumn("_rank", F.lit(1)))
        rest = [c for c in found.columns if c not in (*_KEY, "code")]
        best = both.groupBy(*_KEY, "code").agg(F.max_by(F.struct(*rest), F.struct("_rank", "ord")).alias("_x"), F.min(F.struct("_rank", "ord")).alias("_at"))
        place = F.row_number().over(store.Window.partitionBy(*_KEY).orderBy("_at")) - 1
        laid = best.select(*_KEY, "code", *[F.col(f"_x.{c}").alias(c) for c in rest if c != "ord"], place.alias("ord"))
        found = found.where("owner <> 'attachment'").unionByName(laid)
    parent = tables.nodes.select("file", "node_id", F.col("parent_id").cast("string").alias("parent_id"))
    rows = found.join(parent, ["file", "node_id"])
    rows = rows.select(
        "file", F.col("node_id").cast("string").alias("item_id"), "parent_id", "owner", F.when(F.col("owner") != "message", F.col("child_ix")).alias("child_ix"), F.col("ord").cast("int").alias("ord"), "code",
        F.lit(None).cast("string").alias("name"), F.lit(PS_MAPI).alias("guid"), "ptype", *[c for c in SCHEMA.fieldNames() if c.startswith("v_")],
    )
    lost = message.select("file", "node_id").join(found.where("owner = 'message'").select("file", "node_id").distinct(), ["file", "node_id"], "left_anti").join(parent, ["file", "node_id"])
    error = lost.select("file", F.col("node_id").cast("string").alias("item_id"), "parent_id", F.lit("no property list").alias("v_str"))
    error = error.unionByName(tables.bad.select("file", F.lit(None).cast("string").alias("item_id"), F.lit(None).cast("string").alias("parent_id"), F.concat(F.lit("header: "), F.array_join("broken", ", ")).alias("v_str")))
    whole = rows.unionByName(error.withColumn("owner", F.lit("error")), allowMissingColumns=True)
    return whole.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMA.fields])


def read(spark: SparkSession, path: str, cipher: bytes | None = None, mode: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """(property rows, notes) of all stores under path, of any size that binaryFile reads (2 GB)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][sS][tT]").option("recursiveFileLookup", "true").load(path).select("path", "content")
    tables = relations(files, cipher, mode)
    rows = property_rows(tables)
    return rows, tables.notes.rows(spark)
