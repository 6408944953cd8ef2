"""Connected components by rounds of contraction, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b); root is the smallest node of its component.

    Each round merges every node into the first of itself and its neighbours, and the edges between what is left, each
    once, go to the next round, until there are none. First is by id, which ends stars to their smallest node at once,
    and every other round by a hash that is new in each: that leaves at most three quarters of the nodes on average
    whatever the graph (Bögeholz, Brand and Todor, In-database connected component analysis), so rounds follow the
    logarithm of the nodes. Minima are taken before each shuffle, joins read tables on both sides, so Spark can split
    a hot node's rows.
    """

    def between(rows: DataFrame, a: str, b: str) -> DataFrame:
        return written(rows.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges")

    left, rounds = between(edges, "a", "b"), []
    while not left.isEmpty():
        k = len(rounds)

        def order(node: str, k: int = k) -> Column:
            return F.struct(F.xxhash64(F.lit(k), node).alias("h") if k % 2 else F.lit(0).alias("h"), F.col(node).alias("id"))

        ends = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = ends.groupBy(F.col("a").alias("node")).agg(F.min(order("b")).alias("m"))
        rounds.append(written(first.select("node", F.least(order("node"), "m")["id"].alias("root")), "merged"))
        near = left.join(rounds[-1].select(F.col("node").alias("a"), F.col("root").alias("c")), "a").select("c", "b")
        left = between(near.join(rounds[-1].select(F.col("node").alias("b"), F.col("root").alias("d")), "b"), "c", "d")
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # Backwards, so that each round's rows are joined once: a node that was not merged further is its own root.
    labels = rounds.pop()
    while rounds:
        labels = written(rounds.pop().join(labels.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root")), "labels")
    least = labels.groupBy("root").agg(F.min("node").alias("top"))
    return written(labels.join(least, "root").select("node", F.col("top").alias("root")), "labels")
