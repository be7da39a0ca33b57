"""Message files read as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources import msg, pst, rows

#: Columns of Spark's binaryFile source.
_FILES = "path string, modificationTime timestamp, length long, content binary"


def property_rows(spark: SparkSession, path: str, cipher: bytes | None = None, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the property rows of .msg and .pst files that are put under path, each file once; rows as the batch readers
    give them, unreadable files as error rows."""

    def parse(name: str, content: bytes):
        return pst.parser(cipher)(name, content) if name.lower().endswith(".pst") else msg.parse(name, content)

    files = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*.{[mM][sS][gG],[pP][sS][tT]}").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(path)
    return rows.parse_files(files, parse)


def append_rows(stream: DataFrame, table: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream of property rows to a Parquet table, exactly once; checkpoint: a folder that all hosts share."""
    return stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
