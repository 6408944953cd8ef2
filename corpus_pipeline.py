"""The corpus pipeline: language ID, near duplicates, decontamination, personal data, packing.

Each stage gets what its predecessor kept, as a table. All but the last return the columns of documents:

- language: a text that is null or has no letter, or whose calibrated score is under MIN_LANGUAGE_SCORE, goes.
- duplicates: of the texts that n-gram Jaccard links connect, the one with the smallest doc_id stays.
- decontamination: a text that holds a benchmark passage goes.
- personal data: spans are replaced by their kind, and n_chars follows.
- packing: one row per piece of a training sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import decontamination, jaccard_join, language_id, packing, pii
from sieveline.llm.common import written

MIN_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the language model rejects: null, empty and blank texts, those without a letter, those of an unsure language.

    A very long text is read whole; equal rows fare alike; no rows give none; other columns, whatever their names, stay.
    """
    return docs.where(language_id.accepted(docs, MIN_LANGUAGE_SCORE))


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class: that with the smallest doc_id, of several texts under it the one with the smallest digest.

    Rows without words or without doc_id all stay, save that rows with a doc_id that are equal in every column are one.
    A very long text is one set of shingles; no rows give none; other columns, whatever their names, stay.
    """
    return jaccard_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts with benchmark passages.

    Null and empty texts hold none; a very long text is searched whole; equal rows fare alike; no rows give none, and an
    empty benchmark drops none; other columns, whatever their names, stay.
    """
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in texts by its kind, and sets n_chars, if there is one, to the new length.

    A null text stays null, with a null n_chars; a very long text is searched whole; equal rows fare alike; no rows give
    none; other columns, whatever their names, stay.
    """
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences, of 2,048 tokens at most: one row per piece.

    A null text is empty, and its piece is the end id; a very long text fills several sequences; equal rows are packed
    each; no rows give no pieces; other columns are not read.
    """
    import public_tokenizers

    pieces = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language", language),
    ("duplicates", duplicates),
    ("decontamination", decontaminate),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: Trained models, MinHash and tokenizers can't be put in SQL; tests compare each stage with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
