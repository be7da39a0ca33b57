"""Block and node tables of a store: look-ups, chains, file ranges, fixed-width tables, special folders."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import binary
from .joins import small
from .scratch import written_counting


def block_kind(block_id: Column, first: Column) -> Column:
    """data, chain or submap, by the id's second bit and the first byte; unknown for other blocks."""
    internal = block_id.bitwiseAND(F.lit(2)) != 0
    return F.when(~internal, "data").when(first == 1, "chain").when(first == 2, "submap").otherwise("unknown")


def node_blocks(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """nodes with offset and size of their data block and their sub-node block; null where there is none."""
    one = lambda p: blocks.select(F.col("file_id").alias(f"_{p}f"), F.col("block_id").alias(f"_{p}b"), F.col("offset").alias(f"{p}_offset"), F.col("size").alias(f"{p}_size"))
    out = nodes
    for p, column in (("data", "data_block"), ("sub", "sub_block")):
        out = out.join(one(p), (F.col("file_id") == F.col(f"_{p}f")) & (F.col(column) == F.col(f"_{p}b")), "left").drop(f"_{p}f", f"_{p}b")
    return out


def sub_blocks(submap: DataFrame, blocks: DataFrame, id2: int | None = None) -> DataFrame:
    """Blocks behind the ids of sub-node maps; of a repeated id the first counts. submap: file_id, owner, id2, block_id, ord."""
    wanted = submap if id2 is None else submap.where(F.col("id2") == id2)
    first = wanted.groupBy("file_id", "owner", "id2").agg(F.min_by("block_id", "ord").alias("block_id"))
    return first.join(blocks.select("file_id", "block_id", "offset", "size"), ["file_id", "block_id"])


def expand_chains(heads: DataFrame, links: DataFrame, keys: list[str] | None = None, circles: bool = False) -> DataFrame:
    """Leaf blocks of chains in reading order: head_id, block_id, place. heads: head_id; links: block_id, place, child_id
    (a block without links is a leaf). keys: columns of both tables that tell files apart.

    Chains are taken apart level by level until only leaves are left, at any depth; a block inside itself is not entered again.
    circles: give these too, with circle true and the place of the block that starts over."""
    keys = keys or []
    below = links.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("block_id").alias("_block"), F.col("place").cast("long").alias("_place"), "child_id")
    same = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("block_id") == F.col("_block")]
    level = heads.select(*keys, "head_id", F.col("head_id").alias("block_id"), F.array().cast("array<long>").alias("place"), F.array("head_id").alias("seen"), F.lit(False).alias("circle")).distinct()
    out = None
    while True:
        joined = level.join(below, functools.reduce(lambda a, b: a & b, same), "left").withColumn("leaf", F.col("child_id").isNull() | F.col("circle"))
        joined, seen = written_counting(joined.select(*keys, "head_id", "block_id", "place", "seen", "circle", "leaf", "_place", "child_id"), "chains", open="not leaf")
        ended = joined.where("leaf").select(*keys, "head_id", "block_id", "place", "circle").distinct()
        out = ended if out is None else out.unionByName(ended)
        if not seen["open"]:
            break
        level = joined.where("not leaf").select(*keys, "head_id", F.col("child_id").alias("block_id"), F.array_append("place", F.col("_place")).alias("place"), F.array_append("seen", F.col("child_id")).alias("seen"), F.array_contains("seen", F.col("child_id")).alias("circle"))
    out = out if circles else out.where("not circle").drop("circle")
    return out.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "head_id").orderBy("place")) - 1)


def expand_submaps(roots: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """Sub-node maps with what their nested maps hold: keys, owner, id2, block_id, ord (an entry stands before those of the map it leads
    to). roots: owner; entries: owner, ord, id2, block_id, nested (a map block, 0 for none). A map inside itself is not entered again."""
    own = entries.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("owner").alias("_at"), F.col("ord").cast("long").alias("_ord"), "id2", "block_id", "nested")
    level = roots.select(*keys, "owner", F.col("owner").alias("at"), F.array().cast("array<long>").alias("ord"), F.array("owner").alias("seen")).distinct()
    out = None
    while True:
        joined = level.join(own, functools.reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("at") == F.col("_at")]))
        joined = joined.select(*keys, "owner", "id2", "block_id", "nested", F.array_append("ord", F.col("_ord")).alias("ord"), "seen")
        joined, seen = written_counting(joined, "submaps", open="nested <> 0 AND NOT array_contains(seen, nested)")
        out = joined.drop("nested", "seen") if out is None else out.unionByName(joined.drop("nested", "seen"))
        if not seen["open"]:
            return out
        level = joined.where("nested <> 0 AND NOT array_contains(seen, nested)").select(*keys, "owner", F.col("nested").alias("at"), "ord", F.array_append("seen", F.col("nested")).alias("seen"))


def concatenated(pieces: DataFrame, keys: list[str], most_bytes: int) -> DataFrame:
    """(keys, data, n_bytes, note) of values that stand in pieces: keys, place, block_id, size, data. A value of more than most_bytes
    is not put together: data is null and note `too long` (its pieces stay rows); blocks of which some are encoded and some
    aren't give `mixed encryption` and no data. Sizes are summed before any bytes meet, so no cell grows beyond the bound."""
    flag = F.col("block_id").bitwiseAND(F.lit(2)) != 0
    sizes = pieces.groupBy(*keys).agg(F.sum("size").alias("n_bytes"), (F.count_if(flag) % F.count(F.lit(1)) != 0).alias("_mixed"))
    note = F.when(F.col("_mixed"), "mixed encryption").when(F.col("n_bytes") > most_bytes, "too long")
    sizes = sizes.select(*keys, "n_bytes", note.alias("note"))
    good = pieces.join(sizes.where("note is null").select(*keys), keys, "left_semi")
    joined = good.groupBy(*keys).agg(F.expr("listagg(data) WITHIN GROUP (ORDER BY place)").alias("data"))
    return sizes.join(joined, keys, "left").select(*keys, "data", "n_bytes", "note")


def mixed_flags(members: DataFrame) -> DataFrame:
    """Chains whose blocks are partly encrypted. members: head_id, block_id."""
    flag = F.col("block_id").bitwiseAND(F.lit(2)) != 0
    return members.groupBy("head_id").agg(F.count_distinct(flag).alias("kinds")).where("kinds > 1").select("head_id")


def range_gaps(ranges: DataFrame, owner: str = "file_id", unit: int = 64) -> DataFrame:
    """ranges (owner, offset, size) with padded size and gap to the next range of the owner; a negative gap is an overlap."""
    padded = F.col("size") + F.pmod(-F.col("size"), F.lit(unit))
    following = F.lead("offset").over(Window.partitionBy(owner).orderBy("offset", "size"))
    return ranges.withColumn("padded", padded).withColumn("gap", following - (F.col("offset") + F.col("padded")))


def table_rows(tables: DataFrame) -> DataFrame:
    """Records of fixed-width tables: table_id, row, record. tables: table_id, data (binary), rec_size."""
    count = F.floor(F.octet_length("data") / F.col("rec_size")).cast("int")
    rows = tables.where(count > 0).select("table_id", "data", "rec_size", F.explode(F.sequence(F.lit(0), count - 1)).alias("row"))
    return rows.select("table_id", "row", F.substring(F.col("data"), F.col("row") * F.col("rec_size") + 1, F.col("rec_size")).alias("record"))


def project(record: Column, offset: Column | int, size: Column | int) -> Column:
    """A column's bytes in a record."""
    return F.substring(record, (F.lit(offset) if isinstance(offset, int) else offset) + 1, F.lit(size) if isinstance(size, int) else size)


def column_descriptors(tables: DataFrame, keys: list[str], schema: str = "schema") -> DataFrame:
    """The columns that tables say they have: keys, column (from 0), ref_type, code, offset, size. schema: descriptors of 8 bytes, one
    after another: type, code and offset of 2 bytes each, size and slot of one."""
    h = F.hex(F.col(schema))
    at = lambda i: F.col("column") * 8 + i
    out = tables.where(F.octet_length(schema) >= 8).select(*keys, h.alias("_h"), F.explode(F.sequence(F.lit(0), F.floor(F.octet_length(schema) / 8).cast("int") - 1)).alias("column"))
    number = lambda i, n: binary.le_hex(F.col("_h"), at(i), n).cast("int")
    return out.select(*keys, "column", number(0, 2).alias("ref_type"), number(2, 2).alias("code"), number(4, 2).alias("offset"), number(6, 1).alias("size"))


def cells(records: DataFrame, columns: DataFrame, keys: list[str]) -> DataFrame:
    """The cells of records by their own table's columns: records with column, ref_type, code, size, cell (bytes) and raw (the number of cells
    of up to 4 bytes). records: keys, record, ...; columns: as column_descriptors gives them. Each table has its own layout."""
    out = records.join(columns, keys)
    cell = project(F.col("record"), F.col("offset"), F.col("size"))
    fits = F.col("offset") + F.col("size") <= F.octet_length("record")
    out = out.withColumn("cell", F.when(fits, cell))
    raw = F.when((F.col("size") > 0) & (F.col("size") <= 4), F.coalesce(binary.le_uint(F.substring("cell", 1, 4)).cast("long"), F.lit(0)))
    return out.withColumn("raw", raw).drop("record", "offset")


def dereference(refs: DataFrame, slots: DataFrame, keys: list[str], ref: str = "ref") -> DataFrame:
    """refs with what they lead to inside their heap: kind (none, heap, subnode, bad), data and note. slots: keys, place, slot, value.
    Nothing is behind 0; bad references, and those to slots that aren't there, give no bytes and the note `bad reference`. The
    data of sub-nodes is left null, for sub_values."""
    parts = binary.heap_reference(F.col(ref).cast("long"))
    out = refs.withColumn("_r", parts).withColumns({"kind": F.col("_r.kind"), "_place": F.col("_r.block"), "_slot": F.col("_r.slot")}).drop("_r")
    right = slots.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("place").alias("_of_place"), F.col("slot").alias("_of_slot"), "value")
    on = functools.reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("_place") == F.col("_of_place"), F.col("_slot") == F.col("_of_slot")])
    missing = (F.col("kind") == "bad") | ((F.col("kind") == "heap") & F.col("value").isNull())
    out = out.join(right, on, "left").withColumns({"data": F.when(missing, F.lit(b"")).otherwise(F.col("value")), "note": F.when(missing, "bad reference")})
    return out.drop("_place", "_slot", "_of_place", "_of_slot", "value", *[f"_{k}" for k in keys])


def least_record_size(columns: DataFrame) -> DataFrame:
    """Sum of the column sizes of each table. columns: table_id, size."""
    return columns.groupBy("table_id").agg(F.sum("size").alias("least_size"))


def latest_time(streams: DataFrame) -> DataFrame:
    """Latest time of a file's streams, the creation time standing in for a missing modification time."""
    return streams.groupBy("item_id").agg(F.max(F.coalesce("modified", "created")).alias("latest"))


def embedded_kind(children: DataFrame) -> DataFrame:
    """Objects with more than two children named as parts of messages. children: object_id, name."""
    like = F.col("name").rlike(r"^__(substg1|properties_version1|nameid_version1|attach_version1|recip_version1)\.0")
    return children.groupBy("object_id").agg((F.count_if(like) > 2).alias("is_message"))


def named_columns(columns: DataFrame, names: DataFrame, types: dict[int, str]) -> DataFrame:
    """Table columns (ref_type, code) with type_name and prop_name from the dictionaries, else hexadecimal."""
    kinds = columns.sparkSession.createDataFrame([(c, n.split("_", 1)[1].lower()) for c, n in types.items()], "_t int, _type string")
    props = names.select(F.col("code").alias("_c"), F.col("symbol").alias("_symbol"))
    out = columns.join(small(kinds), F.col("ref_type") == F.col("_t"), "left").join(small(props), F.col("code") == F.col("_c"), "left")
    name = lambda found, code: F.coalesce(F.col(found), F.format_string("0x%04x", F.col(code)))
    return out.withColumns({"type_name": name("_type", "ref_type"), "prop_name": name("_symbol", "code")}).drop("_t", "_type", "_c", "_symbol")


def remaining(all_rows: DataFrame, used: DataFrame) -> DataFrame:
    """Rows that were not used, counting repeats."""
    return all_rows.exceptAll(used)
