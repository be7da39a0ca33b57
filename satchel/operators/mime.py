"""Mail as a tree of parts: one row a part, whatever the depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .scratch import written_counting


def _level(raw: DataFrame, keys: list[str]) -> DataFrame:
    """Parts (keys, path, raw) taken apart: what is no multipart has a body, a multipart its pieces. Each cut is a column of its own, so
    that no text is searched twice."""
    whole = F.concat(F.lit("\n"), "raw")  # so that a part without headers starts with its empty line
    out = raw.select(*keys, "path", F.split(whole, "\r?\n\r?\n", 2).alias("_cut"))
    out = out.select(*keys, "path", text.parse_headers(F.element_at("_cut", 1)).alias("headers"), F.coalesce(F.try_element_at("_cut", F.lit(2)), F.lit("")).alias("body"))
    kind = F.try_element_at(F.transform(F.filter("headers", lambda h: F.lower(h["name"]) == "content-type"), lambda h: h["value"]), F.lit(1))
    out = out.withColumn("kind", kind)
    out = out.withColumns({"_multi": text.is_multipart(F.lower(F.trim("kind"))), "_mark": text.boundary_of(F.col("kind"))})
    multi, mark = F.col("_multi"), F.col("_mark")
    out = out.withColumn("_halves", text.around_end(F.when(multi, F.col("body")), mark))
    out = out.withColumn("_pieces", text.between_boundaries(F.element_at("_halves", 1), mark))
    out = out.withColumn("split", F.when(F.col("_halves").isNotNull(), text.parts_found(F.col("_halves"), F.col("_pieces"))))
    note = F.when(multi & mark.isNull(), "no boundary").when(F.col("split").isNotNull() & ~F.col("split.closed"), "not closed")
    return out.select(
        *keys, "path", F.lower(text.header_main(F.col("kind"))).alias("content_type"), "headers", F.when(F.col("split").isNull(), F.col("body")).alias("body"),
        F.col("split.preamble").alias("preamble"), F.col("split.epilogue").alias("epilogue"), note.alias("note"), F.col("split.parts").alias("pieces"),
    )


def part_tree(mails: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, content_type, headers, body, preamble, epilogue, note): all parts of mails (keys, text). path: places from 1, empty for
    the mail itself. A multipart has no body but a preamble and an epilogue, and its parts are rows of their own.

    Parts are taken apart level by level until none is a multipart; a level's texts are no longer than those of the level above, and
    shorter by the boundaries, so this ends at any depth. note: `no boundary` for a multipart that names none (a part with a body
    then), `not closed` where the last boundary is missing (the last part then goes on to the end, and there is no epilogue).
    Null texts have no rows."""
    raw = mails.where("text is not null").select(*keys, F.array().cast("array<int>").alias("path"), F.col("text").alias("raw"))
    out = None
    while True:
        level, seen = written_counting(_level(raw, keys), "parts", open="size(pieces) > 0")
        out = level.drop("pieces") if out is None else out.unionByName(level.drop("pieces"))
        if not seen["open"]:
            return out
        below = level.where("pieces is not null").select(*keys, "path", F.posexplode("pieces").alias("_at", "raw"))
        raw = below.select(*keys, F.array_append("path", F.col("_at") + 1).alias("path"), "raw")


def tree_lines(parts: DataFrame) -> Column:
    """A part's line in the drawn tree, behind two blanks for each level."""
    return F.concat(F.repeat(F.lit("  "), F.size("path")), F.lit("- #<Mime content_type="), F.coalesce(F.concat(F.lit('"'), parts["content_type"], F.lit('"')), F.lit("nil")), F.lit(">"))
