"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordering import fresh
from ..sources.shared import shared_path, written

__all__ = ["bound_batches", "documents", "free_shuffles", "fresh", "frugal", "n_partitions", "shared_path", "smallest_by_hash", "text_bytes", "tidy", "tidy_group", "written"]

#: Values of a column that is taken as a class: a model has a column for each, and sampling a rank within each.
MOST_CLASSES = 1000
#: Input of one Arrow batch to a Python worker; long texts must not pile up to 10,000 a batch.
ARROW_BATCH_BYTES = 2 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def frugal(tokenizes: bool = False) -> None:
    """Before a task: large blocks go back to the system when they are free, and what an earlier operator learned goes now."""
    _return_blocks()
    if not tokenizes and f"{__package__}.pieces" in sys.modules:
        sys.modules[f"{__package__}.pieces"].forget()


@functools.lru_cache
def _return_blocks() -> None:
    """From now on this worker gives large blocks back to the system as soon as they are free: numpy's, by glibc's thresholds, and Arrow's."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 4 << 20)  # M_TRIM_THRESHOLD
    pa.set_memory_pool(pa.system_memory_pool())


def give_back() -> None:
    """Returns what this worker has freed and still holds."""
    gc.collect()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator], tokenizes: bool = False) -> Callable[[Iterator], Iterator]:
    """run over a task's batches, after which the worker gives back the memory that it freed.

    A worker stays for the tasks after this one, and for a minute without any; several stages' workers would each keep
    what their largest task took.
    """

    @functools.wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        frugal(tokenizes)
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def tidy_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for a function of a group's rows."""

    @functools.wraps(run)
    def tidied(table: pa.Table) -> pa.Table:
        frugal()
        out = run(table)
        if table.nbytes > ARROW_BATCH_BYTES:
            give_back()
        return out

    return tidied


def free_shuffles(spark: SparkSession) -> None:
    """Asks for the disk of shuffles that finished steps no longer need.

    Spark removes their files when the driver's JVM has collected what stood for them, which on a quiet driver can be
    long after the next step has filled the disk. What the last job used stays until another has run, so call this after
    a small one. Only a classic session has a JVM to ask.
    """
    gc.collect()
    if (jvm := getattr(spark, "_jvm", None)) is not None:
        jvm.System.gc()


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column, to size partitions by."""
    return df.select(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def n_partitions(spark: SparkSession, size: int, each: int) -> int:
    """Partitions of about `each` bytes, and at least as many as the session shuffles into."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def smallest_by_hash(rows: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """(key, by, k): of each class the n rows whose key has the smallest hash, numbered from 1; keys are distinct within a class.

    Classes are few, which is checked, and their counts give a bound on the hash under which about 3 n rows of a class
    lie, so that no more than these are sorted, however large the class is.
    """
    counts = rows.groupBy(by).agg(F.count("*").alias("n")).limit(MOST_CLASSES + 1).collect()
    if len(counts) > MOST_CLASSES:
        raise ValueError(f"{by} has more than {MOST_CLASSES} values, so it is no class")
    if not counts:
        return rows.select(key, by, F.lit(0).alias("k"))
    in_class = F.create_map(*(F.lit(x) for r in counts for x in (r[by], r["n"])))
    h = F.xxhash64(key)
    near = rows.select(key, by).where(F.pmod(h, F.lit(1 << 30)) * in_class[F.col(by)] < F.lit(3.0 * n * (1 << 30)))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.pmod(h, F.lit(1 << 30)), h, key))
    return near.withColumn("k", rank).where(F.col("k") <= n).select(key, by, "k")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
