"""Gates of a holdout set, and smaller operations on labelled samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The families of holdout sources.
FAMILIES = {
    "automated": ("huggingface_phishing", "huggingface_difraud", "huggingface_sms_spam"),
    "public": ("phishtank", "ftc"),
    "community": ("reddit_rscams", "manual"),
}


def _list(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))


def source_gates(df: DataFrame, source: str = "source", label: str = "label", families: dict[str, tuple[str, ...]] = FAMILIES, rows: tuple[int, int] = (200, 500), least_safe: int = 40) -> DataFrame:
    """One row: n_rows, n_safe, the families present, whether only automated ones are, and whether all gates pass.

    Sources are few (known names and what isn't known), so their set is small however many rows there are.
    """
    one = df.agg(F.count("*").alias("n_rows"), F.count_if(F.col(label) == "safe").alias("n_safe"), F.collect_set(source).alias("sources"))
    automated, *others = families
    present = F.array_compact(F.array(*(F.when(F.arrays_overlap("sources", _list(s)), F.lit(f)) for f, s in families.items())))
    only = F.size(F.array_except("sources", _list(families[automated]))) == 0
    other = F.arrays_overlap("sources", _list(sum((families[f] for f in others), ())))
    passed = F.col("n_rows").between(*rows) & other & (F.col("n_safe") >= least_safe)
    return one.select("n_rows", "n_safe", F.array_join(present, ",").alias("families"), only.alias("automated_only"), passed.alias("passed"))


def overridden(df: DataFrame, vector: Column, label: Column) -> DataFrame:
    """Accepted samples with the vector and label that were asked for, whatever they came with."""
    return df.withColumn("vector", vector).withColumn("label", label)


def class_ratio(df: DataFrame, label: str, of: str = "ham", to: str = "spam") -> DataFrame:
    """ratio: rows of one class to each of the other, null without any of the other."""
    count = lambda x: F.count_if(F.col(label) == x)
    return df.agg((count(of) / F.nullif(count(to), F.lit(0))).alias("ratio"))


def split_of(df: DataFrame, split: str | None = None, column: str = "split") -> DataFrame:
    """The rows of a split, or all where none is asked for."""
    return df if split is None else df.where(F.col(column) == split)


def counts_by_split(splits: dict[str, DataFrame], by: str) -> DataFrame:
    """(by, <split> ..., total) for every value that any split has."""
    counted = None
    for name, df in splits.items():
        rows = df.groupBy(by).agg(F.count("*").alias("n")).withColumn("split", F.lit(name))
        counted = rows if counted is None else counted.union(rows)
    each = [F.coalesce(F.sum(F.when(F.col("split") == name, F.col("n"))), F.lit(0)).alias(name) for name in splits]
    return counted.groupBy(by).agg(*each, F.sum("n").alias("total"))
