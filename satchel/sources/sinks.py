"""Outputs: one text for each message, or one combined text for each folder and kind; names that don't clash."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions import text
from ..operators.scratch import written

#: The combined output of each kind.
COMBINED = {"eml": "Mail.mbox", "vcf": "Contacts.vcf", "txt": "Posts.txt"}


#: Rows of one name that are numbered in one task.
HOT_NAME_ROWS = 100_000
_HOT_PARTS = 64
_NUMBERED, _NUMBERED_PLAIN = r"(?s)^(.*)\.([1-9][0-9]{0,17})(\.[^.]+)$", r"(?s)^(.*)\.([1-9][0-9]{0,17})$"


def _placed(rows: DataFrame, name: str, order: str, hot_rows: int) -> DataFrame:
    """rows with _place, from 1, of each row among those of its name, in order. A name of over hot_rows rows is dealt out by the
    hash of `order` first, and numbered part by part."""
    hot = rows.groupBy(F.col(name).alias("_name")).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > hot_rows).select("_name", F.lit(True).alias("_hot"))
    dealt = rows.join(hot, F.col(name).eqNullSafe(F.col("_name")), "left").withColumn("_part", F.when(F.col("_hot"), F.pmod(F.xxhash64(order), F.lit(_HOT_PARTS))).otherwise(0)).drop("_name", "_hot")
    sizes = dealt.groupBy(F.col(name).alias("_name"), F.col("_part").alias("_own")).agg(F.count(F.lit(1)).alias("_rows"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_rows").over(Window.partitionBy("_name").orderBy("_own").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.where("_before > 0").select("_name", "_own", "_before")
    placed = dealt.withColumn("_place", F.row_number().over(Window.partitionBy(name, "_part").orderBy(order)))
    placed = placed.join(before, F.col(name).eqNullSafe(F.col("_name")) & (F.col("_part") == F.col("_own")), "left")
    return placed.withColumn("_place", (F.col("_place") + F.coalesce("_before", F.lit(0))).cast("long")).drop("_part", "_name", "_own", "_before")


def _running(rows: DataFrame, key: str, at: str, tie: str, weight: str, span: int) -> DataFrame:
    """rows with _sum: the sum of weight over the rows of the key up to this one, by `at` and `tie`. Stretches of `span` places are
    summed up one by one, so that no key is bound to one task."""
    parts = rows.withColumn("_stretch", F.floor(F.col(at) / span))
    sums = parts.groupBy(key, "_stretch").agg(F.sum(weight).alias("_own"))
    before = sums.select(F.col(key).alias("_of_key"), F.col("_stretch").alias("_of_stretch"), (F.sum("_own").over(Window.partitionBy(key).orderBy("_stretch")) - F.col("_own")).alias("_before"))
    inner = F.sum(weight).over(Window.partitionBy(key, "_stretch").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0))
    out = parts.withColumn("_sum", inner).join(before, (F.col(key) == F.col("_of_key")) & (F.col("_stretch") == F.col("_of_stretch")))
    return out.withColumn("_sum", F.col("_sum") + F.col("_before")).drop("_of_key", "_of_stretch", "_before", "_stretch")


def unique_filenames(rows: DataFrame, name: str, order: str, hot_rows: int = HOT_NAME_ROWS, taken: DataFrame | None = None) -> DataFrame:
    """rows with filename, no two the same. The first row of each name, in order, keeps it; each further one gets the first number
    of .2, .3 and so on before the extension that gives a name which no row has by itself, nor an earlier one. taken: a table of
    names (filename) that are there already; a name among them is given to no row. A null name stays null.

    Numbered names of different names never clash, so only names that look numbered by themselves are in the way. If the b-th of
    these, in order, has the number k, it shifts the rows from place k - b + 1 on by one; a running sum over rows and such names
    gives each row its shift."""
    placed = _placed(rows, name, order, hot_rows)
    known = rows.select(F.col(name).alias("_x"), F.lit(False).alias("_taken"))
    if taken is not None:
        known = known.unionByName(taken.select(F.col("filename").alias("_x"), F.lit(True).alias("_taken")))
    known = known.where("_x is not null").groupBy("_x").agg(F.bool_or("_taken").alias("_taken"))
    with_end, plain = F.col("_x").rlike(_NUMBERED), F.col("_x").rlike(_NUMBERED_PLAIN) & ~F.regexp_extract("_x", _NUMBERED_PLAIN, 1).rlike(r"\.[^.]+$")
    base = F.when(with_end, F.concat(F.regexp_extract("_x", _NUMBERED, 1), F.regexp_extract("_x", _NUMBERED, 3))).when(plain, F.regexp_extract("_x", _NUMBERED_PLAIN, 1))
    number = F.when(with_end, F.regexp_extract("_x", _NUMBERED, 2)).otherwise(F.regexp_extract("_x", _NUMBERED_PLAIN, 2)).cast("long")
    blocked = known.where(with_end | plain).select(base.alias("_b"), number.alias("_k")).where("_k > 1")
    blocked = blocked.unionByName(known.where("_taken").select(F.col("_x").alias("_b"), F.lit(1).cast("long").alias("_k")))
    blocked = blocked.join(placed.where("_place > 1").select(F.col(name).alias("_b")).unionByName(known.where("_taken").select(F.col("_x").alias("_b"))).distinct(), "_b", "left_semi")
    shifts = _running(blocked.withColumn("_one", F.lit(1)), "_b", "_k", "_k", "_one", hot_rows).select("_b", (F.col("_k") - F.col("_sum") + 1).alias("_at"))
    crowded = shifts.select("_b").distinct()
    marks = shifts.select("_b", "_at", F.lit(0).alias("_row"), F.lit(1).alias("_one"))
    places = placed.join(crowded, F.col(name) == F.col("_b"), "left_semi").select(F.col(name).alias("_b"), F.col("_place").alias("_at"), F.lit(1).alias("_row"), F.lit(0).alias("_one"))
    shifted = _running(marks.unionByName(places), "_b", "_at", "_row", "_one", hot_rows).where("_row = 1").select("_b", F.col("_at").alias("_at_place"), F.col("_sum").alias("_shift"))
    out = placed.join(shifted, (F.col(name) == F.col("_b")) & (F.col("_place") == F.col("_at_place")), "left")
    place = F.col("_place") + F.coalesce("_shift", F.lit(0))
    numbered = F.concat(F.regexp_extract(F.col(name), r"(?s)^(.*?)(\.[^.]+)?$", 1), F.lit("."), place.cast("string"), F.regexp_extract(F.col(name), r"(\.[^.]+)$", 1))
    return out.select(*rows.columns, F.when(place == 1, F.col(name)).otherwise(numbered).alias("filename"))


def short_name(name: Column, most: int = 200) -> Column:
    """A name of at most `most` characters: the end of what stands before the extension is cut off (an extension of over 20
    characters counts as none)."""
    extension = F.regexp_extract(name, r"(\.[^.]{1,20})$", 1)
    return F.when(F.length(name) > most, F.concat(F.substring(name, F.lit(1), most - F.length(extension)), extension)).otherwise(name)


def output_name(kind: Column, path: Column | None = None) -> Column:
    """Name of the combined output; with a folder path, the folder's own."""
    plain = F.when(kind == "eml", COMBINED["eml"]).when(kind == "vcf", COMBINED["vcf"]).when(kind == "txt", COMBINED["txt"])
    return plain if path is None else F.when(path.isNull(), plain).otherwise(text.combined_filename(path, plain))


def mbox_entry(mime: Column, date: Column, sender: str = "MAILER-DAEMON") -> Column:
    """A message as an mbox entry: the separator with a sender and the message's own date, and mboxrd quoting. A carriage return at
    the very end gets its line feed, which would else be the box's."""
    return F.concat(F.lit(f"From {sender} "), F.coalesce(text.rfc2822(date), F.lit("Thu, 01 Jan 1970 00:00:00 +0000")), F.lit("\n"), F.regexp_replace(text.mboxrd(mime), r"\r\z", "\r\n"))


def write_combined(messages: DataFrame, path: str, append: bool = True) -> None:
    """Write messages (out_name, ord, content) as text under path/out_name=..., entries of one output in order. A large
    output is several part files, ranges of ord, so that no output is bound to one task."""
    spark = messages.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = messages.select("out_name", "ord", F.col("content").alias("value")).repartitionByRange(parts, "out_name", "ord").sortWithinPartitions("out_name", "ord")
    ordered.select("out_name", "value").write.mode("append" if append else "overwrite").partitionBy("out_name").text(path)


def merge_combined(spark: SparkSession, path: str, target: str) -> list[str]:
    """One file under target for each output that write_combined wrote under path: its parts, one after another, copied by the
    driver a buffer at a time. The names of the files."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, place = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(target)
    files, out_files = source.getFileSystem(conf), place.getFileSystem(conf)
    names = []
    for folder in files.listStatus(source):
        mark, _, name = folder.getPath().getName().partition("=")
        if mark != "out_name":
            continue
        name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(name)
        out = out_files.create(jvm.org.apache.hadoop.fs.Path(place, name), True)
        try:
            for part in sorted(str(x.getPath()) for x in files.listStatus(folder.getPath()) if x.getPath().getName().startswith("part-")):
                data = files.open(jvm.org.apache.hadoop.fs.Path(part))
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(data, out, conf, False)
                data.close()
        finally:
            out.close()
        names.append(name)
    return sorted(names)


class FileWriter(DataSourceArrowWriter):
    """Rows (name, content) as files. Each task writes into a folder of its own under the target; the driver moves the files of
    the tasks that count to their names when all are done, and takes all such folders away if the job fails. So no file is ever
    seen half written, and a task that runs twice leaves no second set."""

    def __init__(self, path: str):
        self.path, self.staging = path, f"_staging-{uuid.uuid4().hex}"

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, base = self._files()
        own = f"{self.staging}/{uuid.uuid4().hex}"
        files.create_dir(f"{base}/{own}", recursive=True)
        for batch in iterator:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                with files.open_output_stream(f"{base}/{own}/{name}") as out:
                    if data.is_valid:
                        out.write(data.as_buffer())
        return Written(own)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        files, base = self._files()
        with ThreadPoolExecutor(16) as pool:
            for message in messages:
                if message is not None:
                    found = files.get_file_info(fs.FileSelector(f"{base}/{message.folder}"))
                    list(pool.map(lambda x: files.move(x.path, f"{base}/{x.base_name}"), found))
        files.delete_dir(f"{base}/{self.staging}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, base = self._files()
        with contextlib.suppress(FileNotFoundError):
            files.delete_dir(f"{base}/{self.staging}")


@dataclass
class Written(WriterCommitMessage):
    folder: str


class Files(DataSource):
    """df.write.format("satchel_files"): rows of a name and its content (text or bytes)."""

    @classmethod
    def name(cls) -> str:
        return "satchel_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return FileWriter(self.options["path"])


def write_files(rows: DataFrame, path: str, name: str, content: str) -> int:
    """Write the content (text or bytes) of each row to path/name, from the executors; path: of a store that Arrow's file
    systems know. Names must differ; a file of that name that is there is replaced. The number of files."""
    spark, seen = rows.sparkSession, Observation()
    spark.dataSource.register(Files)
    # files are moved to their names even where the job has no rows, so the folder is there
    counted = rows.select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content")).observe(seen, F.count(F.lit(1)).alias("n"))
    counted.write.format("satchel_files").option("path", path).mode("append").save()
    return seen.get["n"]


def names_in(spark: SparkSession, path: str) -> DataFrame:
    """(filename) of what stands in a folder, for unique_filenames; listed by the driver through Hadoop's file systems."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [x.getPath().getName() for x in files.listStatus(target)] if files.exists(target) else []
    return spark.createDataFrame([(x,) for x in found], "filename string")


def save_attachments(attachments: DataFrame, path: str) -> int:
    """Write attachments (filename, attach_data) to files of their names, numbered where these repeat; embedded objects, which
    have no bytes of their own, are refused. The number of files."""
    if attachments.where("attach_data is null").limit(1).count():
        raise ValueError("can only save attachments with bytes")
    safe = attachments.withColumn("_safe", F.when(F.coalesce("filename", F.lit("")) == "", "attachment").otherwise(short_name(text.safe_filename(F.col("filename"))))).drop("filename")
    order = F.concat_ws("/", *[c for c in ("file", "item_id", "ord") if c in attachments.columns])
    named = unique_filenames(written(safe.withColumn("_order", order), "attachments"), "_safe", "_order", taken=names_in(attachments.sparkSession, path))
    return write_files(named, path, "filename", "attach_data")


def print_messages(messages: DataFrame, out) -> None:
    """Write messages (ord, content) to a text stream on the driver in order, one partition at a time."""
    for row in messages.orderBy("ord").select("content").toLocalIterator():
        out.write(row.content)
