"""The property rows that both store readers give."""

from __future__ import annotations

import datetime
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: owner: message, folder, recipient, attachment, or error for what could not be read (the reason in v_str).
SCHEMA = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("item_id", T.StringType()), T.StructField("parent_id", T.StringType()), T.StructField("owner", T.StringType()),
    T.StructField("child_ix", T.IntegerType()), T.StructField("ord", T.IntegerType()), T.StructField("code", T.IntegerType()), T.StructField("name", T.StringType()),
    T.StructField("guid", T.StringType()), T.StructField("ptype", T.IntegerType()), T.StructField("v_str", T.StringType()), T.StructField("v_int", T.LongType()),
    T.StructField("v_dbl", T.DoubleType()), T.StructField("v_bool", T.BooleanType()), T.StructField("v_ts", T.TimestampType()), T.StructField("v_bin", T.BinaryType()),
    T.StructField("v_arr", T.ArrayType(T.StringType())), T.StructField("v_arr_bin", T.ArrayType(T.BinaryType())),
])
EPOCH = datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)


def from_filetime(ticks: int) -> datetime.datetime | None:
    micros = (ticks - 116444736000000000) // 10
    try:
        return EPOCH + datetime.timedelta(microseconds=micros)
    except OverflowError:
        return None


def typed(value: object) -> dict:
    """The column that holds a value."""
    if value is None:
        return {}
    if isinstance(value, bool):
        return {"v_bool": value}
    if isinstance(value, int):
        return {"v_int": value}
    if isinstance(value, float):
        return {"v_dbl": value}
    if isinstance(value, str):
        return {"v_str": value}
    if isinstance(value, datetime.datetime):
        return {"v_ts": value}
    if isinstance(value, list):
        return {"v_arr_bin" if any(isinstance(x, bytes) for x in value) else "v_arr": value}
    return {"v_bin": bytes(value)}


def scan(spark: SparkSession, path: str, pattern: str, parse: Callable[[str, bytes], Iterator[dict]]) -> DataFrame:
    """Rows of all files under path whose names match the pattern, read by Spark."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return parse_files(files, parse)


def parse_files(files: DataFrame, parse: Callable[[str, bytes], Iterator[dict]], batch_rows: int = 500) -> DataFrame:
    """Rows of files (path, content), parsed file by file; a file that can't be parsed gives an error row."""
    files = files.select("path", "content")
    fields = SCHEMA.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(SCHEMA)

        def give(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(f) for r in rows], schema.field(f).type) for f in fields], names=fields)

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, size = [], 0
                try:
                    for row in parse(name, content.as_py()):
                        rows.append({"file": name, **row})
                        size += len(row.get("v_bin") or b"") + 100
                        if len(rows) >= batch_rows or size > 8 << 20:
                            yield give(rows)
                            rows, size = [], 0
                except (ValueError, IndexError, KeyError, OverflowError, RecursionError, struct.error) as e:
                    rows.append({"file": name, "owner": "error", "v_str": f"{type(e).__name__}: {e}"})
                if rows:
                    yield give(rows)

    return files.mapInArrow(run, SCHEMA)
