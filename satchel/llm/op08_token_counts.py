"""Token counts: Arrow functions that return lengths only.

Batches are cut by bytes. For byte-level tokenizers texts are split at boundaries that are safe for their pattern (see
pieces.py), so a long text is many short calls unless it has neither blanks nor line ends. Other tokenizers, whose safe
boundaries are not known, encode whole texts in runs of bytes.

Null and empty texts have no tokens. Rows are kept as they are: repeated rows give repeated results, null ids stay.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns
from .pieces import text_encoder


def token_counts(docs: DataFrame, tokenizer: str, text_col: str = "text", limit: int = 1024, keep: list[str] | None = None) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit). No shuffle; columns of these names are replaced."""

    def make():
        counts = text_encoder(tokenizer).counts
        return lambda texts: [pc.binary_length(texts).cast(pa.int64()), pa.array(counts(texts), pa.int64())]

    out = append_columns(docs, text_col, [("n_bytes", T.LongType()), ("n_tokens", T.LongType())], make, keep)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
