"""Mail texts: single messages (.eml) and boxes of them (mbox), read by Spark's text source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text


def read_mbox(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file, ord, separator, text) of the messages of all boxes under path; ord grows along a file.

    A record ends where a line starts with `From `, so the text source finds the start of a message in any split, and a large box is
    as many tasks as it has splits. separator is the rest of that line. In the text one `>` is taken from lines that are `From `
    behind any number of them. Bare line feeds at a message's end belong to the box, as does a lone carriage return; a line end of
    both characters stays. Bytes that aren't UTF-8 become U+FFFD."""
    reader = spark.read.option("lineSep", "\nFrom ").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    rows = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ord"), F.regexp_replace("value", r"\AFrom ", "").alias("value"))
    lines = F.split("value", "\r?\n", 2)
    body = F.regexp_replace(F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit("")), r"(?<!\r)\n+\z|\r\z", "")
    return rows.where("value <> ''").select("file", "ord", F.element_at(lines, 1).alias("separator"), text.from_mboxrd(body).alias("text"))


def read_eml(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, text) of the single messages under path, each a whole file."""
    rows = spark.read.option("pathGlobFilter", "*.[eE][mM][lL]").option("recursiveFileLookup", "true").text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.lit(0).cast("long").alias("ord"), F.col("value").alias("text"))


def parsed(mails: DataFrame) -> DataFrame:
    """mails with headers (name and value, in order) and body; operators.mime.part_tree goes on into multiparts."""
    return mails.withColumns({"headers": text.parse_headers(text.header_block(F.concat(F.lit("\n"), "text"))), "body": text.message_body(F.concat(F.lit("\n"), "text"))})
