"""MSG files as relations: sectors of compound files are put in order inside their row by array expressions, directory entries become
rows with their bytes, storages are told by joins, and properties of all files are decoded together.

    files -> headers (format rules) -> sector chains -> directory entries with data -> owners (pointer doubling)
    -> messages, recipients, attachments, embedded messages -> streams, fixed values, name maps -> typed property rows

A chain of sectors is ranked by pointer doubling over the allocation table as an array: after log2 of its length rounds each sector
knows the last one of its chain and its distance from it; sorted by these, each chain is a slice. A file is one row
up to its directory entries, so a file's sectors never travel; everything is Spark expressions, without Python workers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..dictionary import PS_MAPI
from ..functions import binary
from ..operators import properties, store
from ..operators.checks import Notes, checked
from ..operators.scratch import written, written_counting
from .rows import SCHEMA
from .store_frames import typed

#: Allocation table entries from this one on are no sectors; kinds of directory entries; prefixes of storages.
_NO_SECTOR, _STORAGE, _STREAM, _ROOT = 0xFFFFFFFA, 1, 2, 5
_RECIPIENT, _ATTACHMENT, _NAMES, _FIXED, _OBJECT = "__recip_version1.0_", "__attach_version1.0_", "__nameid_version1.0", "__properties_version1.0", "__substg1.0_3701000D"


def _le(data: Column, at: Column | int, size: int) -> Column:
    """A number of binary data at a zero-based offset; null where the data is too short."""
    at = F.lit(at) if isinstance(at, int) else at
    turned = F.concat(*[F.hex(F.substring(data, (at + (size - i)).cast("int"), F.lit(1))) for i in range(size)])
    return F.when(F.octet_length(data) >= at + size, F.conv(turned, 16, 10).try_cast("long"))


def _power(n: Column) -> Column:
    return F.when(n < 31, F.pow(F.lit(2.0), n)).cast("int")


def headers(files: DataFrame) -> DataFrame:
    """(file, content, length, signature, size, mini_size, n_fat, first_dir, cutoff, first_mini, first_difat, n_difat)."""
    c = F.col("content")
    return files.select(
        F.col("path").alias("file"), "content", F.octet_length("content").alias("length"), F.hex(F.substring("content", 1, 8)).alias("signature"), _power(_le(c, 30, 2)).alias("size"),
        _power(_le(c, 32, 2)).alias("mini_size"), _le(c, 44, 4).alias("n_fat"), _le(c, 48, 4).alias("first_dir"), _le(c, 56, 4).alias("cutoff"), _le(c, 60, 4).alias("first_mini"),
        _le(c, 68, 4).alias("first_difat"), _le(c, 72, 4).alias("n_difat"),
    )


HEADER_RULES = {
    "signature": lambda: F.col("signature") == "D0CF11E0A1B11AE1", "length": lambda: F.col("length") >= 512, "sector size": lambda: F.col("size").isin(512, 4096),
    "mini sector size": lambda: F.col("mini_size").between(8, 512),
}


def _numbers(data: Column) -> Column:
    """Binary data as an array of 4-byte numbers."""
    turned = F.regexp_replace(F.hex(data), "(..)(..)(..)(..)", "$4$3$2$1")
    return F.transform(F.regexp_extract_all(turned, F.lit("(.{8})"), F.lit(1)), lambda x: F.conv(x, 16, 10).cast("long"))


def _ranked(links: Column) -> Column:
    """last and steps of each place of an array of links: where its chain ends and how far that is. A link to nowhere ends a chain; on
    circles the last one is no end."""
    size = F.size(links)
    start = F.struct(
        F.transform(links, lambda x, i: F.when(x < size, x.cast("int")).otherwise(i)).alias("last"),
        F.transform(links, lambda x, i: F.when((x < size) & (x != i), 1).otherwise(0)).alias("steps"),
    )
    rounds = F.ceil(F.log2(F.greatest(size, F.lit(2)).cast("double"))).cast("int")
    double = lambda st, _: F.struct(
        F.transform(st["last"], lambda x: F.get(st["last"], x)).alias("last"),
        F.transform(st["steps"], lambda n, i: n + F.get(st["steps"], F.get(st["last"], i))).alias("steps"),
    )
    return F.aggregate(F.sequence(F.lit(1), rounds), start, double)


def _with_chains(df: DataFrame, links: str, name: str) -> DataFrame:
    """df with what chain() reads of a column of links. Sectors stand in order of their chain's end and of their distance from it, so
    that a chain is a slice; where chains run into one another, two sectors are as far from one end, and chains are followed instead."""
    size = F.size(links)
    out = df.withColumn("_ranked", _ranked(F.col(links)))
    last, steps = F.col("_ranked.last"), F.col("_ranked.steps")
    out = out.withColumn("_sorted", F.sort_array(F.transform(last, lambda x, i: F.struct(x.alias("last"), (-F.get(steps, i)).alias("k"), i.alias("s")))))
    at = F.sort_array(F.transform("_sorted", lambda x, i: F.struct(x["s"].alias("s"), i.alias("i"))))
    ends = F.transform(last, lambda x: (F.get(F.col(links), x) >= size) | (F.get(F.col(links), x) == x))
    merged = F.size(F.array_distinct(F.transform("_sorted", lambda x: F.struct(x["last"], x["k"])))) < size
    chains = F.struct(F.transform("_sorted", lambda x: x["s"]).alias("order"), F.transform(at, lambda x: x["i"]).alias("at"), steps.alias("steps"), ends.alias("ends"), merged.alias("merged"))
    return out.withColumn(name, chains).drop("_ranked", "_sorted")


def _chain(start: Column, chains: Column, links: Column) -> Column:
    """The places of a chain in order, none for a start that is no place or comes to a circle."""
    first = F.when(start < F.size(links), start.cast("int"))
    steps = F.get(chains["steps"], first)
    follow = lambda found, _: F.array_append(found, F.get(links, F.element_at(found, -1)).cast("int"))
    followed = F.aggregate(F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")), F.array(first), follow)
    found = F.when(chains["merged"], followed).otherwise(F.slice(chains["order"], F.get(chains["at"], first) + 1, steps + 1))
    return F.when(F.coalesce(F.get(chains["ends"], first), F.lit(False)), found).otherwise(F.array().cast("array<int>"))


def _joined(data: Column, places: Column, size: Column, skip: int) -> Column:
    """The sectors of binary data at places, one after another; skip: sectors before the first."""
    return F.unhex(F.array_join(F.transform(places, lambda s: F.hex(F.substring(data, (s + skip) * size + 1, size))), ""))


def directory(heads: DataFrame) -> DataFrame:
    """(file, sid, name, type, left, right, child, created, modified, n_bytes, data) of all directory entries of compound files, streams
    with their bytes. heads: as headers() gives them."""
    c, size = F.col("content"), F.col("size")
    sector = lambda n: F.substring(c, ((n + 1) * size + 1).cast("int"), size)
    # places of the allocation table: 109 in the header, more in a chain of sectors of their own
    more = F.aggregate(
        F.when(F.col("n_difat").between(1, 100000), F.sequence(F.lit(1).cast("long"), F.col("n_difat"))).otherwise(F.array().cast("array<long>")),
        F.struct(F.col("first_difat").alias("next"), F.array().cast("array<long>").alias("found")),
        lambda st, _: F.when(st["next"] >= F.lit(_NO_SECTOR), st).otherwise(F.struct(_le(sector(st["next"]), size - 4, 4).alias("next"), F.concat(st["found"], F.slice(_numbers(sector(st["next"])), F.lit(1), F.floor(size / 4).cast("int") - 1)).alias("found"))),
        lambda st: st["found"],
    )
    listed = F.filter(F.concat(_numbers(F.substring(c, 77, 436)), more), lambda x: x < F.lit(_NO_SECTOR))
    out = heads.withColumn("fat", F.flatten(F.transform(F.slice(listed, F.lit(1), F.greatest(F.col("n_fat").cast("int"), F.lit(0))), lambda s: _numbers(sector(s)))))
    # a file has no more sectors than its length holds, of whatever size its table is
    out = out.withColumn("fat", F.slice("fat", F.lit(1), F.greatest(F.ceil(F.col("length") / size).cast("int") - 1, F.lit(0))))
    out = _with_chains(out, "fat", "chains")
    whole = lambda start: _joined(c, _chain(start, F.col("chains"), F.col("fat")), size, 1)
    out = out.withColumns({"dir": whole(F.col("first_dir")), "mini": _numbers(whole(F.col("first_mini")))})
    out = out.withColumn("mini_data", whole(_le(F.col("dir"), 116, 4)))
    out = out.withColumn("mini", F.slice("mini", F.lit(1), F.ceil(F.octet_length("mini_data") / F.col("mini_size")).cast("int")))
    out = _with_chains(out, "mini", "mini_chains")
    many = F.floor(F.octet_length("dir") / 128).cast("int")
    raw = F.when(many > 0, F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.struct(i.alias("sid"), F.substring(F.col("dir"), i * 128 + 1, F.lit(128)).alias("r"))))
    raw = F.transform(raw, lambda x: F.struct(x["sid"].alias("sid"), x["r"].alias("r"), _le(x["r"], 66, 1).alias("kind"), _le(x["r"], 116, 4).alias("start"), _le(x["r"], 120, 4).alias("n")))

    def entry(x: Column) -> Column:
        r = x["r"]
        kind, start, n = x["kind"], x["start"], x["n"]
        small = _joined(F.col("mini_data"), _chain(start, F.col("mini_chains"), F.col("mini")), F.col("mini_size"), 0)
        data = F.substring(F.when(n < F.col("cutoff"), small).otherwise(whole(start)), F.lit(1), n.cast("int"))
        return F.struct(
            x["sid"].alias("sid"), binary.utf16_text(F.substring(r, F.lit(1), F.greatest(_le(r, 64, 2).cast("int") - 2, F.lit(0)))).alias("name"), kind.alias("type"), _le(r, 68, 4).alias("left"), _le(r, 72, 4).alias("right"),
            _le(r, 76, 4).alias("child"), binary.le_long(F.substring(r, 101, 8)).alias("created"), binary.le_long(F.substring(r, 109, 8)).alias("modified"), n.alias("n_bytes"), F.when(kind == _STREAM, data).alias("data"),
        )

    return out.select("file", F.inline(F.transform(raw, entry)))


def owners(entries: DataFrame) -> DataFrame:
    """(file, sid, owner): the storage that each entry lies in. An entry is reached from its storage or from an entry beside it; the
    way up beside is followed by pointer doubling. What isn't reached from a storage is left out."""
    link = lambda column, beside: entries.where(F.col("type").isin(_STORAGE, _ROOT) if not beside else F.lit(True)).select("file", F.col(column).alias("sid"), F.col("sid").alias("up"), F.lit(beside).alias("beside"))
    links = link("left", True).unionByName(link("right", True)).unionByName(link("child", False))
    used = entries.where(F.col("type").isin(_STORAGE, _STREAM)).select("file", F.col("sid").cast("long").alias("sid"))
    # an entry that is linked twice is taken from one of its links
    links = links.join(used, ["file", "sid"], "left_semi").groupBy("file", "sid").agg(F.min_by(F.struct("up", "beside"), F.struct("beside", "up")).alias("x")).select("file", "sid", F.col("x.up").cast("long").alias("up"), "x.beside")
    now, seen = written_counting(links, "owners", open="beside")
    before = None
    while seen["open"] and seen["open"] != before:
        before = seen["open"]
        ahead = now.select("file", F.col("sid").alias("up"), F.col("up").alias("_up"), F.col("beside").alias("_beside"))
        moved = now.join(ahead, ["file", "up"], "left").select("file", "sid", F.when(F.col("beside"), F.col("_up")).otherwise(F.col("up")).alias("up"), (F.col("beside") & F.coalesce("_beside", F.lit(True))).alias("beside"))
        now, seen = written_counting(moved.where("up is not null"), "owners", open="beside")
    return now.where("not beside").select("file", F.col("sid").cast("int").alias("sid"), F.col("up").cast("int").alias("owner"))


def items(entries: DataFrame) -> DataFrame:
    """(file, sid, item_id, parent_id, owner, child_ix) of the storages that hold properties: messages, recipients and attachments; an
    embedded message is an item `item/attachment`. entries: with owner and place (in the storage, by name)."""
    kind = F.when(F.startswith("name", F.lit(_RECIPIENT)), "recipient").when(F.startswith("name", F.lit(_ATTACHMENT)), "attachment")
    parts = entries.where("type = 1").select("file", "sid", F.col("owner").alias("up"), kind.alias("kind"), "name", "order").where(F.col("kind").isNotNull() | (F.col("name") == _OBJECT))
    numbered = Window.partitionBy("file", "up", "kind").orderBy("order", "sid")
    parts = written(parts.withColumn("ix", F.row_number().over(numbered) - 1), "storages")
    whole = store.embedded_kind(entries.select(F.struct("file", "owner").alias("object_id"), "name")).where("is_message").select("object_id.file", F.col("object_id.owner").alias("sid"))
    inner = parts.where("kind is null").join(whole, ["file", "sid"], "left_semi").select("file", F.col("sid").alias("_sid"), F.col("up").alias("_up"))
    level = entries.where("sid = 0").select("file", "sid", F.col("file").alias("item_id"), F.lit(None).cast("string").alias("parent_id"))
    out = None
    while True:
        below = level.select("file", F.col("sid").alias("up"), "item_id", "parent_id").join(parts.where("kind is not null"), ["file", "up"])
        own = level.select("file", "sid", "item_id", "parent_id", F.lit("message").alias("owner"), F.lit(None).cast("int").alias("child_ix"))
        found = own.unionByName(below.select("file", "sid", "item_id", "parent_id", F.col("kind").alias("owner"), F.col("ix").alias("child_ix")))
        out = found if out is None else out.unionByName(found)
        attached = below.where("kind = 'attachment'").select("file", F.col("sid").alias("_up"), "item_id", "ix")
        level, seen = written_counting(attached.join(inner, ["file", "_up"]).select("file", F.col("_sid").alias("sid"), F.concat_ws("/", "item_id", F.col("ix").cast("string")).alias("item_id"), F.col("item_id").alias("parent_id")), "embedded", open="true")
        if not seen["open"]:
            return out


def property_rows(files: DataFrame, mode: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """(property rows as sources/rows.py has them, notes) of MSG files (path, content)."""
    notes = Notes()
    heads, bad, _ = checked(headers(files), {k: v() for k, v in HEADER_RULES.items()}, mode, "message-headers")
    notes.add(bad, F.array_join("broken", ", "), "header")
    entries = written(directory(heads), "entries")
    notes.add(entries.where(f"type = {_STREAM}"), F.when(F.coalesce(F.octet_length("data"), F.lit(0)) < F.col("n_bytes"), "short read"), F.col("name"))
    # names in a storage stand by length, then by upper case
    rank = F.struct(F.length("name").alias("n"), F.upper("name").alias("u"))
    placed = entries.where("sid = 0").withColumn("owner", F.lit(None).cast("int")).unionByName(entries.join(owners(entries), ["file", "sid"])).withColumn("order", rank)
    placed = written(placed.select("file", "sid", "owner", "name", "type", "order", "data"), "placed")
    own = written(items(placed.drop("data")), "items")
    streams = placed.where(f"type = {_STREAM}").withColumn("s", properties.substream(F.col("name")))
    notes.add(placed.where("owner is not null"), F.when(~F.col("name").rlike(r"^__(substg1|properties_version1|nameid_version1|attach_version1|recip_version1)\.0|^[\x01-\x06]"), "unknown entry"), F.col("name"))
    held = streams.join(own.select("file", F.col("sid").alias("owner"), F.col("item_id"), "parent_id", F.col("owner").alias("kind"), "child_ix"), ["file", "owner"])
    base = ["file", "item_id", "parent_id", "kind", "child_ix"]
    # streams of their own, pieces of multi-values, and records of 16 bytes behind a head of the rest
    single = held.where("s is not null and not s.multi").select(*base, F.col("s.code").alias("code"), F.col("s.type").alias("ptype"), F.lit(None).cast("long").alias("raw"), "data", F.lit(None).cast("array<binary>").alias("pieces"), "order")
    pieces = held.where("s.multi and s.place is not null").select(*base, F.col("s.code").alias("code"), F.col("s.type").bitwiseOR(F.lit(0x1000)).alias("ptype"), F.col("s.place").alias("place"), "data", "order")
    gaps = pieces.groupBy(*base, "code", "ptype").agg(F.max("place").alias("most"), F.count(F.lit(1)).alias("n"))
    wild = written(gaps.where(F.col("most") > 2 * F.col("n") + 4096), "gaps")
    notes.add(wild, "bad multi-value", F.format_string("0x%04x", "code"), F.col("item_id"))
    key = F.struct("file", "item_id", "kind", F.coalesce("child_ix", F.lit(-1)).alias("ix"), "code", "ptype")
    good = pieces.withColumn("_key", key).join(wild.select(key.alias("_key")), "_key", "left_anti")
    multi = properties.assemble(good, ["_key", *base, "code", "ptype"], value="data").join(good.groupBy("_key").agg(F.min("order").alias("order")), "_key")
    multi = multi.select(*base, "code", "ptype", F.lit(None).cast("long").alias("raw"), F.lit(None).cast("binary").alias("data"), F.col("values").alias("pieces"), "order")
    size = F.octet_length("data")
    record = F.transform(F.when(size >= 16, F.sequence(size % 16, size - 16, F.lit(16))), lambda i: F.substring(F.col("data"), i + 1, F.lit(16)))
    fixed = held.where(F.col("name") == _FIXED).select(*base, "order", F.posexplode(record).alias("at", "r"))
    fixed = fixed.select(*base, "order", _le(F.col("r"), 2, 2).cast("int").alias("code"), _le(F.col("r"), 0, 2).cast("int").alias("ptype"), F.substring("r", 9, 8).alias("data"))
    fixed = fixed.where((F.col("code") != 0) & F.col("ptype").isin(0x0002, 0x0003, 0x000A, 0x000B, 0x0040, 0x0014, 0x0005))
    raw = F.when(F.col("ptype") == 0x000B, _le(F.col("data"), 0, 2)).otherwise(_le(F.col("data"), 0, 4))
    fixed = fixed.select(*base, "code", "ptype", raw.alias("raw"), "data", F.lit(None).cast("array<binary>").alias("pieces"), "order")
    found = single.unionByName(multi).unionByName(fixed)
    # a message's name map, else that of the message it is embedded in: only the outermost one is looked for further out
    maps = placed.where(F.col("name") == _NAMES).select("file", F.col("sid").alias("_storage"), F.col("owner").alias("_of"))
    parts = streams.where("s is not null").select("file", F.col("owner").alias("_storage"), "s.code", "data").join(maps, ["file", "_storage"])
    of_items = own.where("owner = 'message'").select("file", F.col("sid").alias("_of"), "item_id")
    parts = parts.join(of_items, ["file", "_of"])
    piece = lambda code, name: F.coalesce(F.max(F.when(F.col("code") == code, F.col("data"))), F.lit(b"")).alias(name)
    tables = properties.name_map(parts.groupBy("file", "item_id").agg(piece(2, "guids"), piece(3, "entries"), piece(4, "strings")), ["file", "item_id"])
    with_map = tables.select("file", F.col("item_id").alias("map_item")).distinct()
    nearest = own.where("owner = 'message'").select("file", "item_id").join(with_map, "file", "left").where(F.col("map_item").isNull() | (F.col("item_id") == F.col("map_item")) | F.startswith("item_id", F.concat("map_item", F.lit("/"))))
    nearest = nearest.groupBy("file", "item_id").agg(F.max_by("map_item", F.length("map_item")).alias("map_item"))
    found = found.join(nearest, ["file", "item_id"])
    found = properties.named_keys(found, tables.withColumnRenamed("item_id", "map_item"), ["file", "map_item"])
    empty = F.col("ptype") == 0x000D
    values = typed(F.lit(0), F.col("ptype"), F.col("raw"), F.col("data"))
    text = lambda p: F.when(F.col("ptype") == 0x101F, F.regexp_replace(binary.utf16_text(p), r"\x00\z", "")).otherwise(binary.text8(p))
    strings = F.col("pieces").isNotNull() & F.col("ptype").isin(0x101E, 0x101F)
    values |= {
        "v_str": F.when(F.col("ptype") == 0x001F, F.regexp_replace(binary.utf16_text(F.col("data")), r"\x00\z", "")).otherwise(values["v_str"]),
        "v_arr": F.when(strings, F.transform("pieces", text)), "v_arr_bin": F.when(F.col("pieces").isNotNull() & ~strings, F.col("pieces")),
    }
    rows = found.where(~empty | F.col("data").isNotNull()).withColumns(values)
    ord_ = F.row_number().over(Window.partitionBy("file", "item_id", "kind", "child_ix").orderBy("order", "code")) - 1
    rows = rows.select("file", "item_id", "parent_id", F.col("kind").alias("owner"), "child_ix", ord_.alias("ord"), "code", "name", "guid", "ptype", *[c for c in SCHEMA.fieldNames() if c.startswith("v_")])
    error = bad.select("file", F.lit("error").alias("owner"), F.concat(F.lit("header: "), F.array_join("broken", ", ")).alias("v_str"))
    whole = rows.unionByName(error, allowMissingColumns=True).select(*[F.col(f.name).cast(f.dataType) for f in SCHEMA.fields])
    return whole, notes.rows(files.sparkSession)


def read(spark: SparkSession, path: str, mode: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """(property rows, notes) of all MSG files under path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[mM][sS][gG]").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return property_rows(files, mode)
