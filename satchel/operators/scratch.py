"""Tables between the rounds of operators that go round: written to the shared folder and read again, so that plans stay short and
a lost executor costs its own tasks only."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. A local session that names none gets one of its own, which
    is removed when the driver ends; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="satchel-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return _LOCAL[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path for a table or files, deleted when the driver's JVM ends."""
    path = f"{folder(spark)}/satchel/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table that was written and is read again."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_counting(df: DataFrame, name: str, **conditions: str) -> tuple[DataFrame, dict[str, int]]:
    """As written, with the number of rows for which each condition holds, observed while they are written."""
    if not conditions:
        return written(df, name), {}
    seen = Observation()
    counted = df.observe(seen, *[F.count_if(F.expr(c)).alias(k) for k, c in conditions.items()])
    out = written(counted, name)
    return out, seen.get
