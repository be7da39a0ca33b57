"""The registered queries of the training-data operators: thin callers that apply each operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import default_vocabulary, scratch_path


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op01_token_files import read_digests, write_token_files

    path = scratch_path(spark, "token-files")
    write_token_files(_read(spark, sf_dir, "documents"), path, default_vocabulary("byte_bpe_50k.json"), end_id=2)
    return read_digests(spark, path)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op02_toxicity import score, train

    docs = _read(spark, sf_dir, "documents")
    return score(docs, train(docs, _read(spark, sf_dir, "labels")), keep=["doc_id"])


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op03_simhash import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op04_lm import score_texts

    return score_texts(_read(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .op05_bpe import encode_digests

    return encode_digests(_read(spark, sf_dir, "documents"), default_vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"])


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op06_suffix_dedup import remove_repeats

    return remove_repeats(_read(spark, sf_dir, "documents"), with_kept=False)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op07_decontaminate import contamination

    out = contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op08_token_counts import token_counts

    return token_counts(_read(spark, sf_dir, "documents"), default_vocabulary("byte_bpe_50k.json"), keep=["doc_id"])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .op09_line_dedup import deduplicate_lines

    out = deduplicate_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op10_quality import learn_from, quality_filter

    docs = _read(spark, sf_dir, "documents")
    rules = learn_from(docs, _read(spark, sf_dir, "labels"))
    out = quality_filter(docs, rules, keep=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op11_quality_nbsvm import held_out, score, train

    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out()))
    return score(docs, model, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op12_divergence import divergence

    return divergence(_read(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op13_spelling import spelling_variants

    return spelling_variants(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_toxicity, op3_simhash, op4_lm_scoring, op5_byte_bpe, op6_suffix_dedup, op7_decontamination, op8_token_counts, op9_line_dedup, op10_quality_rules, op11_quality_nbsvm, op12_source_divergence, op13_spelling_variants)}


def _oracles() -> dict[str, str]:
    from . import op06_suffix_dedup, op07_decontaminate, op09_line_dedup, op12_divergence, op13_spelling

    return {
        "op6_suffix_dedup": op06_suffix_dedup.ORACLE, "op7_decontamination": op07_decontaminate.ORACLE, "op9_line_dedup": op09_line_dedup.ORACLE,
        "op12_source_divergence": op12_divergence.ORACLE, "op13_spelling_variants": op13_spelling.ORACLE,
    }


ORACLES = _oracles()
