"""Folders of stores: the kind of every item and the path of names it lies under, from property rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import binary, text
from ..operators import tree

ROOT = "33"
#: Codes of the properties that tell folders and special folders.
_NAME, _MASK, _COUNT, _SUBFOLDERS, _SUBTREE, _WASTEBASKET, _FINDER = 0x3001, 0x35DF, 0x3602, 0x360A, 0x35E0, 0x35E3, 0x35E7


def items(rows: DataFrame) -> DataFrame:
    """(file, item_id, parent_id, item_type, name) of the items of stores, which have numbers: root, folder, message, wastebasket or finder.
    rows: as the store reader gives them; parent_id is that after the top folder's children moved to the root."""
    pick = lambda code, column: F.max(F.when(F.col("code") == code, F.col(column)))
    own = rows.where("owner = 'message' AND item_id RLIKE '^[0-9]+$'").groupBy("file", "item_id").agg(
        F.max("parent_id").alias("parent_id"), pick(_NAME, "v_str").alias("name"), pick(_MASK, "v_int").alias("mask"), pick(_COUNT, "v_int").alias("content_count"),
        pick(_SUBFOLDERS, "v_bool").alias("subfolders"), *[pick(code, "v_bin").alias(n) for n, code in (("subtree", _SUBTREE), ("wastebasket", _WASTEBASKET), ("finder", _FINDER))],
    )
    node = lambda c: binary.entry_id_node(F.col(c)).cast("long").cast("string")
    special = own.where(F.col("item_id") == ROOT).select("file", node("subtree").alias("_subtree"), node("wastebasket").alias("_wastebasket"), node("finder").alias("_finder"))
    out = own.join(special, "file", "left")
    named = F.when(F.col("item_id") == ROOT, "root").when(F.col("item_id") == F.col("_wastebasket"), "wastebasket").when(F.col("item_id") == F.col("_finder"), "finder")
    is_subtree = F.coalesce(F.col("item_id") == F.col("_subtree"), F.lit(False))
    moved = F.when((F.col("parent_id") == F.col("_subtree")) | F.col("item_id").isin(F.col("_wastebasket"), F.col("_finder")), ROOT).otherwise(F.col("parent_id"))
    return out.select("file", "item_id", F.coalesce(moved, "parent_id").alias("parent_id"), tree.item_type(named, F.col("mask"), F.col("content_count"), F.col("subfolders"), is_subtree).alias("item_type"), "name")


def paths(rows: DataFrame) -> DataFrame:
    """items() with folder: the names from below the root to the folder an item lies in, joined by slashes; empty below the root,
    null for items under no root or on circles. Only folders are walked; messages join to theirs."""
    all_items = items(rows)
    key = lambda c: F.concat_ws("\x00", "file", c)
    folders = all_items.where("item_type <> 'message'").select(key("item_id").alias("node_id"), key("parent_id").alias("parent_id"), F.lit(0).alias("ord"), F.coalesce("name", F.lit("")).alias("display_name"), "item_type")
    walked = tree.walk(folders.drop("item_type"), folders.where("item_type = 'root'"))
    inside = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.concat_ws("/", text.empty_to_null(F.col("path")), "display_name"))
    inside = walked.join(folders.select("node_id", "display_name"), "node_id").select(F.col("node_id").alias("_parent"), inside.alias("folder"))
    # the root's own parent is itself; it lies in no folder
    return all_items.withColumn("_parent", F.when(F.col("item_type") != "root", key("parent_id"))).join(inside, "_parent", "left").drop("_parent")
