"""Property sets as rows: (item_id, ord, code, name, guid, value), one for each property; code or name is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dictionary import PS_MAPI, PS_PUBLIC_STRINGS
from ..functions import binary
from .joins import small

KEY = ["code", "name", "guid"]


def with_symbol(props: DataFrame, names: DataFrame) -> DataFrame:
    """props with symbol: the dictionary's name of (code, guid), a string key in lower case, null for unmapped keys.
    names: (code, guid, symbol), a dictionary of some thousand rows at most."""
    found = names.select(F.col("code").alias("_code"), F.col("guid").alias("_guid"), F.col("symbol").alias("_symbol"))
    out = props.join(small(found), (F.col("code") == F.col("_code")) & (F.col("guid") == F.col("_guid")), "left")
    return out.withColumn("symbol", F.coalesce(F.lower("name"), "_symbol")).drop("_code", "_guid", "_symbol")


def key_text(spaces: DataFrame):
    """A function of props that adds key: `0x0037`, or the namespace (else the GUID in braces) with the code or name."""

    def run(props: DataFrame) -> DataFrame:
        named = spaces.select(F.col("guid").alias("_guid"), "namespace")
        out = props.join(F.broadcast(named), F.col("guid") == F.col("_guid"), "left")  # the 14 well-known namespaces
        space = F.coalesce("namespace", F.concat(F.lit("{"), F.col("guid"), F.lit("}")))
        number = F.format_string("0x%04x", F.col("code"))
        text = F.when(F.col("name").isNotNull(), F.format_string('#<Key %s/"%s">', space, F.col("name"))).when(F.col("guid") == PS_MAPI, number).otherwise(F.format_string("#<Key %s/%s>", space, number))
        return out.withColumn("key", text).drop("_guid", "namespace")

    return run


def last_wins(props: DataFrame, keys: list[str] | None = None, order: str = "ord", owner: str = "item_id") -> DataFrame:
    """One row for each owner and key: that of the largest order."""
    return _winner(props, [owner, *(keys or KEY)], order, F.max_by)


def first_wins(props: DataFrame, keys: list[str] | None = None, order: str = "ord", owner: str = "item_id") -> DataFrame:
    """One row for each owner and key: that of the smallest order."""
    return _winner(props, [owner, *(keys or KEY)], order, F.min_by)


def _winner(props: DataFrame, keys: list[str], order: str, pick) -> DataFrame:
    rest = [c for c in props.columns if c not in keys]
    best = props.groupBy(*keys).agg(pick(F.struct(*rest), F.col(order)).alias("_best"))
    return best.select(*[F.col(k) if k in keys else F.col(f"_best.{k}").alias(k) for k in props.columns])


def one_for_each_symbol(props: DataFrame) -> DataFrame:
    """Of several keys with one symbol the last in PS_MAPI, else the first. props: with symbol; unmapped rows go."""
    mapi = (F.col("guid") == PS_MAPI).cast("int")
    rank = F.row_number().over(Window.partitionBy("item_id", "symbol").orderBy(mapi.desc(), F.when(mapi == 1, -F.col("ord")).otherwise(F.col("ord"))))
    return props.where(F.col("symbol").isNotNull()).withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def to_records(props: DataFrame, symbols: list[str], value: str = "value") -> DataFrame:
    """One row for each item with a column for each symbol asked for."""
    columns = [F.max(F.when(F.col("symbol") == s, F.col(value))).alias(s) for s in symbols]
    return props.groupBy("item_id").agg(*columns)


def symbols(props: DataFrame) -> DataFrame:
    """Symbols and values of each item, in order of symbol."""
    return props.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("symbol", "value"))).alias("all")).select("item_id", F.col("all.symbol").alias("symbols"), F.col("all.value").alias("values"))


def lookup(props: DataFrame, symbol: str | None = None, code: int | None = None, guid: str = PS_MAPI, name: str | None = None) -> DataFrame:
    """The property of each item by symbol, or by code or name and namespace."""
    if symbol is not None:
        return props.where(F.col("symbol") == symbol)
    return props.where((F.col("guid") == guid) & (F.col("code") == code if name is None else F.col("name") == name))


def shown(props: DataFrame, most: int = 32) -> DataFrame:
    """(item_id, text): all symbols and values by name, values over `most` characters cut to two fewer and `...\"`."""
    quoted = F.concat(F.lit('"'), F.col("value"), F.lit('"'))
    cut = F.when(F.length(quoted) > most, F.concat(F.substring(quoted, 1, most - 2), F.lit('..."'))).otherwise(quoted)
    items = F.sort_array(F.collect_list(F.struct("symbol", F.concat("symbol", F.lit("="), cut).alias("text"))))
    return props.groupBy("item_id").agg(F.array_join(F.transform(items, lambda x: x["text"]), " ").alias("text"))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def name_map(streams: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pseudo, code, name, guid): the keys that codes from 0x8000 on stand for. streams: keys, guids (16 bytes each), entries (8
    bytes each: a number, flags and the code's distance from 0x8000), strings (length and UTF-16 text, found by offset).

    Of the flags the lowest bit says that the number is the offset of a name, the rest counts namespaces: 1 and 2 are well known, 3 and
    up those of guids. A namespace or name that isn't there gives a null guid or name; of a repeated code the last entry counts."""
    h = F.hex("entries")
    many = F.floor(F.octet_length("entries") / 8).cast("int")
    rows = streams.where(many > 0).select(*keys, "guids", "strings", h.alias("_h"), F.explode(F.sequence(F.lit(0), many - 1)).alias("_i"))
    at = lambda i, n: binary.le_hex(F.col("_h"), F.col("_i") * 8 + i, n)
    rows = rows.select(*keys, "guids", "strings", "_i", at(0, 4).alias("_number"), at(4, 2).alias("_flags"), at(6, 2).alias("_offset"))
    space = F.shiftright("_flags", 1).cast("int")
    listed = binary.guid_text(F.substring("guids", 16 * (space - 3) + 1, F.lit(16)))
    guid = F.when(space == 1, PS_MAPI).when(space == 2, PS_PUBLIC_STRINGS).when(space > 2, listed)
    is_name = F.col("_flags") % 2 == 1
    place = F.col("_number").cast("int")
    size = binary.le_hex(F.hex(F.substring("strings", place + 1, F.lit(4))), 0, 4).cast("int")
    name = F.when(place + 4 + size <= F.octet_length("strings"), binary.utf16_text(F.substring("strings", place + 5, size)))
    out = rows.select(*keys, (F.lit(0x8000) + F.col("_offset")).cast("int").alias("pseudo"), "_i", F.when(~is_name, (F.col("_number") % 65536).cast("int")).alias("code"), F.when(is_name, name).alias("name"), guid.alias("guid"))
    best = out.groupBy(*keys, "pseudo").agg(F.max_by(F.struct("code", "name", "guid"), "_i").alias("_x"))
    return best.select(*keys, "pseudo", "_x.code", "_x.name", "_x.guid")


def named_keys(props: DataFrame, names: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Codes from 0x8000 on replaced by the store's named keys; a code without one stays. names: (pseudo, code, name, guid), and keys,
    the columns of both tables that tell files apart."""
    keys = keys or []
    real = names.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("pseudo").alias("_p"), F.col("code").alias("_c"), F.col("name").alias("_n"), F.col("guid").alias("_g"))
    same = (F.col("code") >= 0x8000) & (F.col("code") == F.col("_p"))
    for k in keys:
        same &= F.col(k) == F.col(f"_{k}")
    out = props.join(real, same, "left")
    hit = F.col("_p").isNotNull()
    return out.withColumns({"code": F.when(hit, F.col("_c")).otherwise(F.col("code")), "name": F.when(hit, F.col("_n")), "guid": F.when(hit, F.col("_g")).otherwise(F.lit(PS_MAPI))}).drop("_p", "_c", "_n", "_g", *[f"_{k}" for k in keys])


def changed(props: DataFrame, changes: DataFrame, absent: str = "insert", order: str = "change", owner: str = "item_id") -> DataFrame:
    """props after changes: rows of owner, a key, the other columns of props, the order of the change and deleted (true: the key goes).
    Of several changes of one key the last counts. A changed key keeps the first of its places (ord); a new one stands behind all
    others of its owner, in order of change. absent: what becomes of a change to a key that the owner hasn't got: `insert` it, `ignore` it, or `fail` the job;
    deleting such a key changes nothing unless it is `fail`.

    A key that repeats in props becomes one row: the last value at the first place.

    One aggregation over both tables by owner and key; owners without changes take part in it as well."""
    if absent not in ("insert", "ignore", "fail"):
        raise ValueError(f"unknown way with absent keys: {absent}")
    rest = [c for c in props.columns if c not in (owner, *KEY, "ord")]
    old = props.select(owner, *KEY, F.struct("ord", *rest).alias("_old"), F.lit(None).cast("long").alias("_change"), F.lit(None).cast("boolean").alias("_gone"), F.lit(None).cast(props.select(F.struct(*rest)).schema[0].dataType).alias("_new"))
    new = changes.select(owner, *KEY, F.lit(None).cast(old.schema["_old"].dataType).alias("_old"), F.col(order).cast("long").alias("_change"), F.coalesce("deleted", F.lit(False)).alias("_gone"), F.struct(*rest).alias("_new"))
    # the first place and the last value of a key, and its last change
    both = old.unionByName(new).groupBy(owner, *KEY).agg(
        F.min("_old.ord").alias("_at"), F.max_by("_old", "_old.ord").alias("_old"), F.max("_change").alias("_change"), F.max_by(F.struct("_gone", "_new"), "_change").alias("_last")
    )
    there, touched = F.col("_old").isNotNull(), F.col("_change").isNotNull()
    stays = ~(touched & F.col("_last._gone")) & (there | (F.lit(absent == "insert") & touched))
    if absent == "fail":
        refused = F.raise_error(F.concat(F.lit("no such property: "), F.to_json(F.struct(owner, *KEY))))
        stays = F.when(touched & ~there, refused.cast("boolean")).otherwise(stays)
    kept = both.where(stays)
    last = F.max("_at").over(Window.partitionBy(owner))
    behind = F.row_number().over(Window.partitionBy(owner, F.col("_at").isNull()).orderBy("_change", *KEY))
    place = F.when(F.col("_at").isNotNull(), F.col("_at")).otherwise(F.coalesce(last, F.lit(-1)) + behind)
    values = [F.when(touched, F.col(f"_last._new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c) for c in rest]
    return kept.select(owner, *KEY, place.cast(props.schema["ord"].dataType).alias("ord"), *values).select(*props.columns)


def assemble(pieces: DataFrame, keys: list[str], place: str = "place", value: str = "value") -> DataFrame:
    """Pieces of multi-valued properties as arrays, in order of place; a missing place is null."""
    grouped = pieces.groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct(place, value))).alias("m"), F.max(place).alias("last"))
    return grouped.select(*keys, F.transform(F.sequence(F.lit(0), "last"), lambda i: F.try_element_at("m", i)).alias("values"))


def substream(name: Column) -> Column:
    """code, type, place and multi (a piece of a multi-valued property) of a property stream's name; null for other names."""
    pattern = r"^__substg1\.0_([0-9A-F]{4})([0-9A-F]{4})(?:-([0-9A-F]{8}))?$"
    number = lambda g: F.conv(F.regexp_extract(name, pattern, g), 16, 10).cast("int")
    kind, place = number(2), F.when(F.regexp_extract(name, pattern, 3) != "", number(3))
    multi = kind.bitwiseAND(F.lit(0x1000)) != 0
    return F.when(name.rlike(pattern), F.struct(number(1).alias("code"), F.when(multi & place.isNotNull(), kind.bitwiseAND(F.lit(0xEFFF))).otherwise(kind).alias("type"), F.when(multi, place).alias("place"), multi.alias("multi"), (multi & place.isNull()).alias("header")))


def unknown_streams(names: DataFrame, name: str = "name") -> DataFrame:
    """Names that are no part of a message, counted."""
    known = r"^__substg1\.0_[0-9A-F]{8}(-[0-9A-F]{8})?$|^__properties_version1\.0$|^__nameid_version1\.0$|^__attach_version1\.0_|^__recip_version1\.0_"
    return names.where(~F.col(name).rlike(known)).groupBy(name).count()
