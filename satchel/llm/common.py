"""Helpers shared by the training-data operators: scratch tables and Arrow pass-through functions."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Java and Python forms of the word separator set: blank, tab, line feed, vertical tab, form feed, carriage return.
SEPARATORS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Arrow batches are cut to about this many bytes of text before any per-batch work.
BATCH_BYTES = 6 << 20


#: The folder of local sessions that name none, made at first use and removed when the driver ends.
_LOCAL_SCRATCH: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where that is unset, a local session (tests, one machine) gets a
    temporary one, whose path this module keeps, since that setting can't be changed in a running session; on a cluster each
    host would have its own, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_SCRATCH:
        _LOCAL_SCRATCH.append(tempfile.mkdtemp(prefix="satchel-"))
        atexit.register(shutil.rmtree, _LOCAL_SCRATCH[0], True)
    return _LOCAL_SCRATCH[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, deleted when the driver's JVM ends."""
    path = f"{scratch_dir(spark)}/satchel/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


@contextlib.contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside are deleted as soon as these end, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder and read it again: cuts lineage, and survives lost executors."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    with _shuffles_end(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that no later step reads."""
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_KEPT: dict[tuple, Any] = {}


def per_worker(kind: str, path: str, make: Callable[[str], Any]) -> Any:
    """What make(path) gives, made once in a Python worker, which Spark uses for one task after another; a changed file counts
    as another. A worker keeps few of them."""
    found = os.stat(path)
    key = (kind, path, found.st_size, found.st_mtime_ns)
    if key not in _KEPT:
        if len(_KEPT) >= 2:
            _KEPT.clear()
        _KEPT[key] = make(path)
    return _KEPT[key]


def release_memory() -> None:
    """Give back what a task has freed: a worker lives on, and what its allocators keep counts against the next stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lower_ascii(col):
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, LOWER)


def slices(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece has about `limit` bytes of text; a longer text is a piece of its own."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, begin, total = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > limit:
            ends.append((begin, i))
            begin, total = i, 0
        total += n
    ends.append((begin, len(sizes)))
    for a, b in ends:
        yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The text column as Arrow strings without nulls (null: empty)."""
    col = batch.column(column)
    return pc.fill_null(col.cast(pa.string()) if col.type != pa.string() else col, "")


def append_columns(df: DataFrame, text_col: str, fields: list[tuple[str, T.DataType]], make: Callable[[], Callable[[pa.Array], list[pa.Array]]], keep: list[str] | None = None) -> DataFrame:
    """Each row of df with new columns computed from whole texts, in Arrow batches cut by bytes.

    make() runs once per task (it should take what is costly from per_worker) and returns the function from an Arrow string array to one array per field. Columns of df
    with the name of a new one are replaced. keep: the columns of df to carry (all by default).
    """
    names = [n for n, _ in fields]
    carried = [c for c in (keep if keep is not None else df.columns) if c not in names]
    hidden = "__satchel_text"
    source = df.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{text_col}`").cast("string").alias(hidden))
    schema = T.StructType([*(f for f in source.schema.fields if f.name != hidden), *(T.StructField(n, t, True) for n, t in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        try:
            for whole in batches:
                for batch in slices(whole, hidden):
                    new = compute(texts_of(batch, hidden))
                    columns = [batch.column(c) for c in range(batch.num_columns - 1)]
                    yield pa.RecordBatch.from_arrays([*columns, *new], names=[*batch.schema.names[:-1], *names])
        finally:
            release_memory()

    return source.mapInArrow(run, schema)


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row of each word, words) of `[^\\x20\\x09-\\x0D]+`; pyarrow's ASCII split has exactly these separators."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    rows = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    full = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(full).as_py() and len(flat):
        rows, flat = rows[full.to_numpy(zero_copy_only=False)], flat.filter(full)
    return rows, flat


def default_vocabulary(name: str) -> str:
    """The place of a public tokenizer's file; its folder is a parameter of the session's environment."""
    folder = os.environ.get("SATCHEL_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
