"""Operator 1: token counts of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, documents, tidy


def token_counter(path: str):
    """An Arrow function from a text column to the number of its tokens; only lengths leave the worker."""

    def n_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from .pieces import shared_encoder

        encoder = shared_encoder(path, keep_ids=False)
        for texts in batches:
            yield pa.array(list(encoder.grouped(texts.to_pylist())), pa.int64())

    return F.arrow_udf(tidy(n_tokens, tokenizes=True), "long")


def count_tokens(df: DataFrame, tokenizer_path: str, text: str = "text", over: int = 512) -> DataFrame:
    """Adds n_bytes (UTF-8), n_tokens and over_limit (n_tokens > over) to the rows of df.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted each; an empty table gives no rows;
    columns of these three names that df has already are replaced, others stay. A very long text is counted whole,
    within one task, piece by piece. The plan has no shuffle: a scan and one Arrow step.
    """
    bound_batches(df.sparkSession)
    whole = F.coalesce(F.col(text), F.lit(""))
    counted = df.withColumn("n_bytes", F.octet_length(whole).cast("long")).withColumn("n_tokens", token_counter(tokenizer_path)(whole))
    return counted.withColumn("over_limit", F.col("n_tokens") > over)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
