"""Tables of documents that are changed, looked up and appended to without reading or writing all of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import fresh

BUCKET = "_bucket"


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_documents(df: DataFrame, at: str, key: str, buckets: int = 64) -> None:
    """Writes documents dealt by a hash of their key, a folder a bucket; repeated keys are left as they are."""
    marked = df.withColumn(BUCKET, _bucket(key, buckets))
    marked.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(at)


def read_documents(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.parquet(at).drop(BUCKET)


def upsert(spark: SparkSession, at: str, updates: DataFrame, key: str, merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = 64) -> int:
    """Applies updates to documents written by write_documents, and gives the number of buckets that it rewrote.

    Only buckets that some update's key falls into are read, merged and overwritten; all other files stay as they are.
    merge takes (documents, updates) of these buckets and returns the documents after them, such as
    membership.merged does. An update of a document that isn't there makes one if merge does. Buckets are as many as they
    were when the documents were written. A run that fails before its last step has changed nothing; one that fails
    within it can be run again, if its updates set values rather than add to them.
    """
    b = fresh(updates, BUCKET)
    touched = [r[0] for r in updates.select(_bucket(key, buckets).alias(b)).distinct().collect()]  # at most `buckets`
    if not touched:
        return 0
    documents = spark.read.parquet(at)
    found = documents.where(F.col(BUCKET).isin(touched)).drop(BUCKET)
    after = merge(found, updates).withColumn(BUCKET, _bucket(key, buckets)).select(documents.columns)
    after.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(at)
    return len(touched)


def write_sorted(df: DataFrame, at: str, key: str, files: int) -> None:
    """Writes rows in files of disjoint ranges of the key, and beside them which file holds which range.

    Row groups keep their own bounds, so that what a lookup reads of a file is cut down once more.
    """
    df.repartitionByRange(files, key).sortWithinPartitions(key).write.mode("overwrite").option("parquet.block.size", 4 << 20).parquet(f"{at}/rows")
    rows = df.sparkSession.read.parquet(f"{at}/rows").select(F.col(key), F.col("_metadata.file_path").alias("file"))
    rows.groupBy("file").agg(F.min(key).alias("least"), F.max(key).alias("most")).coalesce(1).write.mode("overwrite").parquet(f"{at}/ranges")  # a row a file


def lookup(spark: SparkSession, at: str, key: str, values: list) -> DataFrame:
    """The rows whose key is one of the values, out of the files that may hold them; no other file is opened.

    Values are what one caller asks for at a time. Nulls are in no range and find nothing.
    """
    wanted = sorted({v for v in values if v is not None})
    rows = spark.read.parquet(f"{at}/ranges").where(F.exists(F.array(*map(F.lit, wanted)), lambda v: v.between(F.col("least"), F.col("most"))) if wanted else F.lit(False))
    files = [r.file for r in rows.select("file").collect()]
    table = spark.read.parquet(f"{at}/rows") if not files else spark.read.parquet(*files)
    return table.where(F.col(key).isin(wanted) if wanted else F.lit(False))


def append_once(df: DataFrame, at: str, batch: str) -> bool:
    """Appends a batch of rows under a name, once: whether it had to be written.

    A batch's rows go into a folder of its own, then its name into the log; a reader sees the batches of the log alone.
    So a run that broke off between the two leaves nothing to be read, and the next one writes the folder anew; a batch
    that is in the log already is passed over. Names are letters, digits, `-` and `_`.
    """
    if not batch.replace("-", "").replace("_", "").isalnum():
        raise ValueError(f"not a batch's name: {batch!r}")
    if batch in committed(df.sparkSession, at):
        return False
    stage_batch(df, at, batch)
    df.sparkSession.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").json(f"{at}/log")
    return True


def stage_batch(df: DataFrame, at: str, batch: str) -> None:
    """Writes a batch's rows, which nobody reads before append_once names it in the log."""
    df.write.mode("overwrite").parquet(f"{at}/rows/batch={batch}")


def committed(spark: SparkSession, at: str) -> set[str]:
    """Names of the batches that are there: the log has a short line for each."""
    try:
        return {r.batch for r in spark.read.schema("batch string").json(f"{at}/log").distinct().collect()}
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return set()


def read_appended(spark: SparkSession, at: str, schema: str) -> DataFrame:
    """The rows of all batches in the log, with the batch's name."""
    names = sorted(committed(spark, at))
    if not names:
        return spark.createDataFrame([], f"{schema}, batch string")
    rows = spark.read.schema(f"{schema}, batch string").option("basePath", f"{at}/rows").parquet(*(f"{at}/rows/batch={n}" for n in names))
    return rows
