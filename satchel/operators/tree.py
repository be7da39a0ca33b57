"""Node trees: children, orphans, pre-order, paths, special folders. Folders are walked; messages join to theirs after."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written, written_counting

def orphans(nodes: DataFrame) -> DataFrame:
    """Nodes without a parent in the table, and those that are their own. nodes: node_id, parent_id."""
    ids = nodes.select(F.col("node_id").alias("_id")).distinct()
    missing = nodes.join(ids, F.col("parent_id") == F.col("_id"), "left_anti")
    return missing.unionByName(nodes.where("node_id = parent_id")).distinct()


def children(nodes: DataFrame) -> DataFrame:
    """(parent_id, node_id, place): nodes under their parents, in order of ord."""
    from pyspark.sql import Window

    ids = nodes.select(F.col("node_id").alias("_id")).distinct()
    own = nodes.where("node_id <> parent_id").join(ids, F.col("parent_id") == F.col("_id"), "left_semi")
    return own.select("parent_id", "node_id", (F.row_number().over(Window.partitionBy("parent_id").orderBy("ord", "node_id")) - 1).alias("place"))


def _parents(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(node_id, parent_id, ord, display_name) with a null parent for roots."""
    top = roots.select(F.col("node_id").alias("_root")).distinct()
    marked = nodes.join(top, F.col("node_id") == F.col("_root"), "left")
    return marked.select("node_id", F.when(F.col("_root").isNull(), F.col("parent_id")).alias("parent_id"), "ord", "display_name")


def walk(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes reached from the roots: node_id, depth, path (names of the ancestors below the root, joined by slashes; null names
    are left out). nodes: node_id (each once), parent_id, ord, display_name; roots: node_id. A walk up ends at the first root.

    By pointer doubling: every node knows an ancestor and the names between; in each round it takes over its ancestor's own
    pointer and puts the names together, so that depth d takes log2 d joins, at any depth. Nodes that never come to a root (below
    circles or missing parents) are left out; a round that brings none to the end shows that the rest are such. Rows are as long
    as paths are; no key gathers rows."""
    own = _parents(nodes, roots)
    top = F.col("parent_id").isNull()
    # far: the ancestor that is known, steps above; path: the names strictly between
    first = own.select("node_id", "display_name", F.col("parent_id").alias("far"), F.when(top, 0).otherwise(1).alias("steps"), F.lit(None).cast("string").alias("path"), top.alias("done"))
    first, seen = written_counting(first, "walk", open="not done")
    done, open_ = first.where("done"), first.where("not done")
    while seen["open"]:
        known = done.unionByName(open_).select(F.col("node_id").alias("far"), F.col("display_name").alias("_name"), F.col("far").alias("_far"), F.col("steps").alias("_steps"), F.col("path").alias("_path"), F.col("done").alias("_done"))
        # the root's own name stands in no path; a part that is empty text counts, one that is null doesn't
        is_root = F.col("_done") & (F.col("_steps") == 0)
        parts = F.filter(F.array("_path", F.when(~is_root, F.col("_name")), "path"), lambda x: x.isNotNull())
        joined = F.when(F.size(parts) > 0, F.array_join(parts, "/"))
        stepped = open_.join(known, "far").select("node_id", "display_name", F.col("_far").alias("far"), (F.col("steps") + F.col("_steps")).alias("steps"), joined.alias("path"), F.col("_done").alias("done"))
        stepped, seen = written_counting(stepped, "walk", open="not done", ended="done")
        if not seen["ended"]:
            break
        done, open_ = done.unionByName(stepped.where("done")), stepped.where("not done")
    return done.select("node_id", F.col("steps").alias("depth"), F.coalesce("path", F.lit("")).alias("path"))


def unreached(nodes: DataFrame, walked: DataFrame) -> DataFrame:
    """Nodes that a walk did not come to: those below no root or on circles."""
    return nodes.join(walked.select("node_id").distinct(), "node_id", "left_anti")


def preorder(nodes: DataFrame, roots: DataFrame, walked: DataFrame | None = None) -> DataFrame:
    """(node_id, place) of the nodes that a walk comes to: place is the node's number, from 1, in the order in which each node stands
    before its children and these stand by ord and node_id; roots by ord and node_id, each before the next one's tree.

    Ranks of a tour of each root's tree: each node is entered and left, the event after each is known from its first child, next
    sibling or parent, and the events behind each are counted by pointer doubling in log2 of their number rounds, those of the largest
    tree. Trees then stand behind one another by the sums of their sizes. No key of the length of a path is made, and no task gets all
    roots; the children of one node are ordered by a window."""
    from pyspark.sql import Window

    reached = (walk(nodes, roots) if walked is None else walked).select("node_id")
    own = written(_parents(nodes, roots).join(reached, "node_id", "left_semi").select("node_id", "parent_id", "ord"), "reached")
    tops, inner = own.where("parent_id is null"), own.where("parent_id is not null")
    beside = Window.partitionBy("parent_id").orderBy("ord", "node_id")
    inner = inner.select("node_id", "parent_id", F.lead("node_id").over(beside).alias("_next"), (F.row_number().over(beside) == 1).alias("_first"))
    none = F.lit(None).cast(own.schema["node_id"].dataType)
    own = written(inner.unionByName(tops.select("node_id", "parent_id", none.alias("_next"), F.lit(False).alias("_first"))), "siblings")
    first = own.where("_first").select(F.col("parent_id").alias("node_id"), F.col("node_id").alias("_child"))
    enter = own.join(first, "node_id", "left").select("node_id", F.lit(True).alias("enter"), F.coalesce("_child", "node_id").alias("to"), F.col("_child").isNotNull().alias("to_enter"))
    leave = own.select("node_id", F.lit(False).alias("enter"), F.coalesce("_next", "parent_id").alias("to"), F.col("_next").isNotNull().alias("to_enter"))
    # behind: entries from this event up to the one pointed at, itself included; root: once the tour's end is reached, whose tree it is
    tour = enter.unionByName(leave).withColumn("behind", F.col("enter").cast("long")).withColumn("root", F.when(F.col("to").isNull(), F.col("node_id")))
    events, seen = written_counting(tour, "tour", open="to is not null")
    done, open_ = events.where("to is null"), events.where("to is not null")
    while seen["open"]:
        ahead = done.unionByName(open_).select(F.col("node_id").alias("to"), F.col("enter").alias("to_enter"), F.col("to").alias("_to"), F.col("to_enter").alias("_to_enter"), F.col("behind").alias("_behind"), F.col("root").alias("_root"))
        moved = open_.join(ahead, ["to", "to_enter"])
        moved = moved.select("node_id", "enter", F.col("_to").alias("to"), F.col("_to_enter").alias("to_enter"), (F.col("behind") + F.col("_behind")).alias("behind"), F.col("_root").alias("root"))
        moved, seen = written_counting(moved, "tour", open="to is not null")
        done, open_ = done.unionByName(moved.where("to is null")), moved.where("to is not null")
    done = done.where("enter").select("node_id", "root", "behind")
    sizes = tops.select("node_id", "ord").join(done.where("node_id = root").select("node_id", F.col("behind").alias("size")), "node_id")
    return done.join(_starts(sizes).withColumnRenamed("node_id", "root"), "root").select("node_id", (F.col("start") - F.col("behind") + 1).cast("long").alias("place"))


def _starts(sizes: DataFrame) -> DataFrame:
    """(node_id, start): the sum of the sizes up to each row, itself included, in order of ord and node_id. Ranges of rows are summed
    by themselves and then shifted by the sums of the ranges before them, one number each."""
    from pyspark.sql import Window

    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(sizes.repartitionByRange(parts, "ord", "node_id").withColumn("_part", F.spark_partition_id()), "sizes")
    totals = ranged.groupBy("_part").agg(F.sum("size").alias("_sum"))
    before = totals.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))  # a row for each range
    within = F.sum("size").over(Window.partitionBy("_part").orderBy("ord", "node_id"))
    return ranged.withColumn("_within", within).join(F.broadcast(before), "_part").select("node_id", (F.col("_within") + F.col("_before")).alias("start"))


def item_type(special, mask, content_count, subfolders, is_subtree):
    """root, folder, message, wastebasket or finder. A count of 0 counts as there; false subfolders do not."""
    folder = mask.isNotNull() | is_subtree | content_count.isNotNull() | F.coalesce(subfolders, F.lit(False))
    return F.coalesce(special, F.when(folder, "folder").otherwise("message"))


def reroot(children_of: DataFrame, subtree: int, extras: list[int], root: int) -> DataFrame:
    """Children of the root: those of the subtree node, then special folders that are not among them.
    children_of: parent_id, node_id, place."""
    own = children_of.where(F.col("parent_id") == subtree).select("node_id", F.lit(0).alias("_group"), "place")
    more = children_of.sparkSession.createDataFrame([(x, i) for i, x in enumerate(extras)], "node_id long, place int")
    more = more.join(own.select("node_id"), "node_id", "left_anti").select("node_id", F.lit(1).alias("_group"), "place")
    return own.unionByName(more).select(F.lit(root).cast("long").alias("parent_id"), "node_id", F.struct("_group", "place").alias("place"))


def tree_text(walked: DataFrame, label: str) -> DataFrame:
    """An indented line for each node, with the place that puts lines in order. walked: depth, place and the label."""
    return walked.select("place", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- "), F.col(label)).alias("line"))


def store_name(nodes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The display name of each store's root. nodes: kind, display_name, and the columns that tell stores apart."""
    return nodes.where("kind = 'root'").select(*(keys or []), F.col("display_name").alias("name"))
