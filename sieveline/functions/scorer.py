"""Model scores as a column: from a table, or from a function over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Scorer(Protocol):
    """Anything that adds a column of scores between 0 and 1 to rows with a text."""

    def __call__(self, df: DataFrame, text: str, name: str) -> DataFrame: ...


def clamp(c: Column) -> Column:
    """Between 0 and 1; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def percent(c: Column) -> Column:
    """A score as a percentage with one decimal, for display."""
    return F.concat(F.format_number(c * 100, 1), F.lit("%"))


def table_scorer(scores: DataFrame, key: str, score: str, missing: float | None = None) -> Scorer:
    """Scores worked out beforehand, joined by key; a row without one gets `missing`."""

    def run(df: DataFrame, text: str, name: str) -> DataFrame:
        known = scores.select(key, F.col(score).alias(name))
        return df.join(known, key, "left").withColumn(name, clamp(F.coalesce(F.col(name), F.lit(missing).cast("double"))))

    return run


def batch_scorer(function: Callable[[list[str]], list[float]]) -> Scorer:
    """Scores by a function from a batch of texts (null: empty) to a batch of numbers."""

    def scores(texts: pa.Array) -> pa.Array:
        return pa.array(function([t or "" for t in texts.to_pylist()]), pa.float64())

    def run(df: DataFrame, text: str, name: str) -> DataFrame:
        return df.withColumn(name, clamp(F.arrow_udf(scores, "double")(F.col(text))))

    return run
