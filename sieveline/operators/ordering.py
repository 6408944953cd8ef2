"""Row numbers and running totals over a whole table, without one task that sees every row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Rows of a small file over all cores, where what follows costs far more than the scan; a table of many splits stays as it is.

    A split is bounded in bytes, which of short rows are millions, and of one row group a single split has all rows; with
    `rows`, a task has about so many at most, however large the table and whatever its layout. They are counted by split,
    so pass a stored table.
    """
    n, most = df.sparkSession.sparkContext.defaultParallelism, 0
    if rows:
        held = df.groupBy(F.spark_partition_id()).count().agg(F.sum("count").alias("rows"), F.max("count").alias("most")).first()
        n, most = max(n, math.ceil((held["rows"] or 0) / rows)), held["most"] or 0
    return df.repartition(n) if df.rdd.getNumPartitions() < n or most > (rows or 0) else df


def _above(cuts: list, c: Column) -> Column:
    """How many of the sorted cuts are smaller than c, by halving."""
    if not cuts:
        return F.lit(0)
    k = len(cuts) // 2
    right = F.lit(len(cuts)) if k + 1 == len(cuts) else _above(cuts[k + 1 :], c) + F.lit(k + 1)
    return F.when(c > F.lit(cuts[k]), right).otherwise(_above(cuts[:k], c))


def range_of(df: DataFrame, order: str, rows: int = 250_000, most: int = 1 << 16) -> Column:
    """The number of a row's range of a numeric column: ranges of about `rows` rows, at approximate quantiles.

    Many ranges are found in two steps, so that an expression has about two times the root of their number.
    """
    n = min(most, max(1, math.ceil(df.count() / rows)))
    if n == 1:
        return F.lit(0)
    cuts = sorted(set(df.agg(F.percentile_approx(order, [k / n for k in range(1, n)], max(10_000, 10 * n)).alias("q")).first()["q"] or []))
    step = max(1, math.isqrt(len(cuts)))
    coarse = _above(cuts[step - 1 :: step], F.col(order))
    if len(cuts) <= 256:
        return _above(cuts, F.col(order))
    fine = F.element_at(F.array(*(F.array(*map(F.lit, cuts[k : k + step])) for k in range(0, len(cuts) + step, step))), (coarse + 1).cast("int"))
    return coarse * step + F.size(F.filter(fine, lambda x: x < F.col(order)))


def running_totals(df: DataFrame, order: str, values: dict[str, Column], by: tuple[str, ...] = (), rows: int = 250_000, then: tuple[str, ...] = ()) -> DataFrame:
    """Adds, by name, the sum of each value over the rows before each row, in order of a numeric column without nulls and, where it has repeats within `by`, of the columns `then`.

    The column is cut into ranges; windows run within the ranges, and each range's start is the total of those before
    it. Without `by` that is a row for each range, which one small window sees; with it, a row for each group and range,
    joined like any other table.
    """
    part, own = fresh(df, "part"), {name: fresh(df, f"own_{name}") for name in values}
    cut = df.withColumn(part, range_of(df, order, rows))
    for name, value in values.items():
        cut = cut.withColumn(own[name], value)
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    keys = [*by, part]
    totals = cut.groupBy(*keys).agg(*(F.sum(o).alias(o) for o in own.values()))
    over = (Window.partitionBy(*by) if by else Window).orderBy(part)
    starts = totals.select(*keys, *(earlier(o, over).alias(f"{o}_start") for o in own.values()))
    within = Window.partitionBy(*keys).orderBy(order, *then)
    out = cut.select("*", *(earlier(o, within).alias(f"{o}_before") for o in own.values()))
    out = out.join(starts if by else F.broadcast(starts), keys)
    return out.select(*df.columns, *((F.col(f"{o}_start") + F.col(f"{o}_before")).alias(name) for name, o in own.items()))


def running_total(df: DataFrame, order: str, value: Column, name: str, by: tuple[str, ...] = (), rows: int = 250_000) -> DataFrame:
    """running_totals of one value."""
    return running_totals(df, order, {name: value}, by, rows)


def numbered(df: DataFrame, order: str, name: str = "row", by: tuple[str, ...] = (), rows: int = 250_000) -> DataFrame:
    """Adds 1, 2, ... in order of a numeric column that is unique within `by`."""
    return running_total(df, order, F.lit(1).cast("long"), name, by, rows).withColumn(name, F.col(name) + 1)


def beside(left: DataFrame, left_order: str, right: DataFrame, right_order: str) -> DataFrame:
    """Row i of left beside row i of right, each in its own order; fails where right has fewer rows."""
    i = fresh(left.join(right.limit(0), F.lit(True)), "i")
    joined = numbered(left, left_order, i).join(numbered(right, right_order, i).withColumn(f"{i}_there", F.lit(True)), i, "left")
    there = F.when(F.col(f"{i}_there").isNull(), F.raise_error(F.lit("fewer rows on the right than on the left"))).otherwise(F.lit(True))
    return joined.where(there).drop(i, f"{i}_there")
