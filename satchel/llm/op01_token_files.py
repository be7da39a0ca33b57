"""Token-ID output: texts to Simple-8b files and back.

File format: a Parquet folder, so that it can be written to and read from any store that Spark reads. A row is a chunk of
whole documents of one shard: shard, seq (order in the shard), first (ids of the shard before the chunk), n_ids, doc_ids,
lengths, and payload, a Simple-8b stream (simple8b.py) of all the chunk's ids. Shards are ranges of doc_id in ascending
order, so the place of a shard in the whole stream is the sum of the shards before it.

Texts travel to their shards and are encoded there: compressed, they are no larger than their ids at two bytes each.

Null and empty texts give the end id alone. Rows with equal doc_id are kept, ordered by a hash of their text; a null doc_id
comes first. Many rows with one doc_id are spread over shards by that hash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .common import slices, texts_of
from .pieces import text_encoder

#: A chunk closes at the first document's end after so many ids.
CHUNK_IDS = 1 << 20
SCHEMA = "shard int, seq long, first long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> None:
    """Encode texts without special tokens, append end_id to each, and write them in ascending order of id_col."""
    spark = docs.sparkSession
    shards = shards or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    source = source.select("doc_id", F.xxhash64("text").alias("h"), "text")
    ordered = source.repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seq, first, held, size = TaskContext.get().partitionId(), 0, 0, [], 0
        table = text_encoder(tokenizer)

        def chunk() -> pa.RecordBatch:
            ids = np.concatenate([h[1] for h in held])
            doc_ids = pa.concat_arrays([h[0] for h in held])
            lengths = np.concatenate([h[2] for h in held])
            row = [[shard], [seq], [first], [len(ids)], [doc_ids.to_pylist()], [lengths], [simple8b.encode(ids)]]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names=["shard", "seq", "first", "n_ids", "doc_ids", "lengths", "payload"])

        for whole in batches:
            for batch in slices(whole, "text"):
                ids, n = table.encode(texts_of(batch, "text"))
                ids = np.insert(ids, np.cumsum(n), np.uint32(end_id))
                held.append((batch.column("doc_id"), ids, n + 1))
                size += len(ids)
                if size >= CHUNK_IDS:
                    yield chunk()
                    seq, first, held, size = seq + 1, first + size, [], 0
        if held:
            yield chunk()

    ordered.select("doc_id", "text").mapInArrow(run, SCHEMA).write.mode("overwrite").parquet(path)


def _shard_starts(files: DataFrame) -> DataFrame:
    """Ids before each shard; one row for each shard, whose number is that of the writer's partitions."""
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    return totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (with the end id) and ids_crc32 of each document, decoded from the files."""
    return _read(spark, path, True)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """As read_documents, without the ids themselves."""
    return _read(spark, path, False)


def _read(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    files = spark.read.schema(SCHEMA).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, doc_ids, lengths, payload in zip(*(batch.column(c).to_pylist() for c in ("shard", "first", "doc_ids", "lengths", "payload"))):
                ids = simple8b.decode(payload).astype("<u4")
                ends = np.cumsum(np.asarray(lengths, np.int64))
                starts = ends - lengths
                raw = ids.tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                columns = [pa.array([shard] * len(ends), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(starts + first, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())]
                names = ["shard", "doc_id", "inside", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    more = ", ids array<int>" if with_ids else ""
    rows = files.select("shard", "first", "doc_ids", "lengths", "payload").mapInArrow(run, f"shard int, doc_id long, inside long, n_tokens long, ids_crc32 long{more}")
    joined = rows.join(F.broadcast(_shard_starts(files)), "shard")  # one row for each shard
    return joined.select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
