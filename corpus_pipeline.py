"""Corpus pipeline over documents: toxicity, line dedup, near-dedup, benchmark decontamination, byte-level BPE.

Each stage gets all rows that the one before it kept. The first four return the columns of documents; the last returns what
encoding and decoding give for each document. Only these columns are carried: others of the input, of whatever name, go. Null ids
and texts, empty texts, repeated rows and empty tables have the results that the operators' modules state. The output of each stage is written as Parquet in the shared folder and read
again, so that a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from satchel.llm import near_text, op02_toxicity, op05_bpe, op07_decontaminate, op09_line_dedup
from satchel.llm.common import default_vocabulary, drop_path, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model does not reject. It is trained on the labels of this input's documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = op02_toxicity.score(docs.select(*COLUMNS), op02_toxicity.train(docs, labels))
    return scored.where(~F.col("rejected")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated line runs; a document of which nothing but white space is left goes."""
    out = op09_line_dedup.deduplicate_lines(docs.select(*COLUMNS))
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    out = out.where(~emptied | F.col("text").isNull())
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each component of texts with a similarity of 0.8 or more in shingles of five words."""
    return near_text.keep_first_similar(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return op07_decontaminate.drop_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with the number and digests of its ids, and the digest of the bytes they decode to."""
    import public_tokenizers

    return op05_bpe.encode_digests(docs, default_vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"])


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("byte_bpe", byte_bpe)]
#: The learned weights, near-duplicate components and BPE have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another, on the documents of sf_dir."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, path = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            drop_path(spark, before)
        before = path
    return docs
