"""Operator 11: vector code compression with segment-mean lower bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, written
from .vectors import quantised

#: Vectors taken together in a task.
AT_ONCE = 4096


def _segments(width: int) -> list[np.ndarray]:
    """Starts of the blocks that each level has, from one block to one per two components or so."""
    levels, n = [], 1
    while n < width or n == 1:
        levels.append(np.unique(np.arange(n) * width // n))
        n *= 2
    return levels


class Codebook:
    """The entries of one part, with their block sums and residual norms by level."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.width = entries, entries.shape[1]
        self.levels = [(starts, *self._level(entries, starts)) for starts in _segments(self.width)]
        self.squares = (entries.astype(np.float64) ** 2).sum(1)

    def _level(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block sums divided by the root of the block's length, and the norm of what the block means leave."""
        lengths = np.diff(np.append(starts, self.width))
        sums = np.add.reduceat(x.astype(np.float64), starts, axis=1) / np.sqrt(lengths)
        rest = (x.astype(np.float64) ** 2).sum(1) - (sums**2).sum(1)
        return sums, np.sqrt(np.maximum(rest, 0.0))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For each row of x its nearest entry (ties to the lower index) and the exact squared distance; also how many distances that took.

        The distance between block means, plus that between the norms of what they leave, never exceeds the distance
        itself, and rises as blocks are halved. An entry goes as soon as its bound is over the exact distance of the
        entry that looked nearest, with room for the rounding of doubles; those that stay are compared exactly.
        """
        n = len(x)
        reach = int(np.abs(x).max(initial=0)) + int(np.abs(self.entries).max(initial=0))
        if self.width * reach * reach >= 1 << 62:
            raise ValueError("squared distances don't fit into 64 bits")
        room = 1e-6 * ((x.astype(np.float64) ** 2).sum(1)[:, None] + self.squares[None, :]) + 1.0
        alive, upper, exact = np.ones((n, len(self.entries)), bool), None, 0
        for starts, sums, norms in self.levels:
            own, left = self._level(x, starts)
            row, entry = np.nonzero(alive)
            low = ((own[row] - sums[entry]) ** 2).sum(1) + (left[row] - norms[entry]) ** 2
            if upper is None:
                first = low.reshape(n, -1).argmin(1)
                upper = ((x - self.entries[first]) ** 2).sum(1)
                exact += n
            alive[row, entry] = low - room[row, entry] <= upper[row]
            alive[np.arange(n), first] = True
        row, entry = np.nonzero(alive)
        distance = np.full(alive.shape, np.iinfo(np.int64).max)
        distance[row, entry] = ((x[row] - self.entries[entry]) ** 2).sum(1)
        best = distance.argmin(1)
        return best, distance[np.arange(n), best], exact + len(row) - n


def _matrices(batches: Iterator[pa.RecordBatch], scale: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Of each stretch of rows: the batch, which of its rows are kept, and their vectors, with zeros after the end of short ones."""
    for whole in batches:
        for at in range(0, whole.num_rows, AT_ONCE):
            batch = whole.slice(at, AT_ONCE)
            kept = list(quantised(batch.column("vector"), scale))
            if kept:
                x = np.zeros((len(kept), width), np.int64)
                for i, (_, v) in enumerate(kept):
                    x[i, : len(v)] = v
                yield batch, np.array([i for i, _ in kept]), x


def _scan(scale: int, n: int):
    """A mapInArrow function: the rows with the n smallest keys (null last) of a task, and the longest vector's length on each."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, longest = [], 0
        for batch in batches:
            keys = batch.column("key").to_pylist()
            for i, v in quantised(batch.column("vector"), scale):
                longest = max(longest, len(v))
                first.append((keys[i] is None, keys[i] or 0, v.tolist()))
            first = sorted(first)[:n]
        if first:
            yield pa.RecordBatch.from_arrays([pa.array([None if x[0] else x[1] for x in first], pa.int64()), pa.array([x[2] for x in first], pa.list_(pa.int64())), pa.array([longest] * len(first), pa.int32())], ["key", "vector", "longest"])

    return scan


def _sums(scale: int, books: list[np.ndarray]):
    """A mapInArrow function: of each part and entry the number and the componentwise sum of a task's vectors nearest to it."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codebooks, wide = [Codebook(b) for b in books], books[0].shape[1]
        total, count = np.zeros((len(books), *books[0].shape), np.int64), np.zeros((len(books), len(books[0])), np.int64)
        for _, _, x in _matrices(batches, scale, wide * len(books)):
            for p, book in enumerate(codebooks):
                own = x[:, p * wide : (p + 1) * wide]
                best, _, _ = book.nearest(own)
                np.add.at(total[p], best, own)
                count[p] += np.bincount(best, minlength=len(book.entries))
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.array(total[p, e].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    return sums


def _codes(scale: int, books: list[np.ndarray]):
    """A mapInArrow function: each kept row's code and error."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codebooks, wide = [Codebook(b) for b in books], books[0].shape[1]
        for batch, rows, x in _matrices(batches, scale, wide * len(books)):
            found = [book.nearest(x[:, p * wide : (p + 1) * wide]) for p, book in enumerate(codebooks)]
            code = np.stack([f[0] for f in found], 1).astype(np.uint8)
            error = np.sum([f[1] for f in found], 0)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(take), batch.column("label").take(take), pa.array([c.tobytes().hex() for c in code]), pa.array(error, pa.int64())], ["key", "label", "code", "error"])

    return codes


def codebooks(rows: DataFrame, parts: int = 8, codes: int = 16, rounds: int = 6, scale: int = 4096) -> list[np.ndarray]:
    """A matrix (entries, components) per part, from rows (key, vector); empty if no row is kept.

    A round is one pass over the vectors: tasks send sums by part and entry, Spark adds them up, and the driver gets the
    totals alone, which are as many as the codebooks have numbers.
    """
    small = rows.select("key", "vector").mapInArrow(_scan(scale, codes), "key long, vector array<long>, longest int")
    longest = small.agg(F.max("longest").alias("n")).first()["n"]
    if longest is None:
        return []
    wide = max(1, -(-longest // parts))
    first = small.orderBy(F.asc_nulls_last("key"), "vector").limit(codes).collect()
    start = np.zeros((len(first), wide * parts), np.int64)
    for i, r in enumerate(first):
        start[i, : len(r.vector)] = r.vector
    books = [start[:, p * wide : (p + 1) * wide].copy() for p in range(parts)]
    for _ in range(rounds):
        sums = rows.select("key", "vector").mapInArrow(_sums(scale, books), "part int, entry int, n long, total array<long>")
        added = sums.select("part", "entry", "n", F.posexplode("total").alias("at", "x")).groupBy("part", "entry", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n"))
        for r in added.collect():
            books[r["part"]][r["entry"], r["at"]] = int(r["x"]) // r["n"]
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, as decimals with commas between them."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, codes: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, list[np.ndarray]]:
    """((key, label, code, error, label_error) of the rows kept, codebooks): product quantisation in integers.

    Components are floor(scale * x), vectors are cut into equal consecutive parts, and each part of the rows with the
    smallest keys starts that part's codebook, which rounds of nearest entries and floored means then move. A code has
    two hex digits a part. error is the squared distance to the entries, label_error its sum over rows with that label,
    nulls together; these sums are a row a label and are joined like any table, so that Spark broadcasts them where they
    are small and splits a hot label where they aren't.

    Rows whose vector is null or holds a null or non-finite component are dropped. Vectors are as long as the longest,
    rounded up to equal parts: a shorter one has zeros after its end. A null key comes after all others; rows that share a
    key stand in order of their vector; equal rows are coded each, and each may start an entry; fewer rows than entries
    give as many entries as rows; no rows give none; other columns, whatever their names, are not read. Squared
    distances must fit into 62 bits, or the job fails.
    """
    spark = df.sparkSession
    bound_batches(spark)
    tag = F.col(label) if label in df.columns else F.lit(None).cast("int")
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"), tag.alias("label")).where("vector is not null")
    books = codebooks(rows, parts, codes, rounds, scale)
    kind = rows.schema["label"].dataType.simpleString()
    if not books:
        return rows.limit(0).select("key", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), []
    coded = written(rows.mapInArrow(_codes(scale, books), f"key long, label {kind}, code string, error long"), "codes")
    totals = written(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).select("key", "label", "code", "error", "label_error"), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return coded.select(F.col("key").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def sql(parts: int = 8, codes: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The same in SQL, a round after the other, by all distances."""
    near = lambda k: f"SELECT v.vec_id, v.part, arg_min(b.entry, (d.x, b.entry)) AS entry, min(d.x) AS error FROM v JOIN b{k} b USING (part), LATERAL (SELECT list_sum(list_transform(list_zip(v.q, b.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS x) d GROUP BY ALL"
    steps = [
        f"""v0 AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"v AS MATERIALIZED (SELECT vec_id, p AS part, q[p * len(q) // {parts} + 1:(p + 1) * len(q) // {parts}] AS q FROM v0, range({parts}) t(p))",
        f"f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v0 ORDER BY vec_id LIMIT {codes})",
        "b0 AS MATERIALIZED (SELECT part, entry, q FROM v JOIN f USING (vec_id))",
    ]
    for k in range(rounds):
        steps.append(f"a{k} AS MATERIALIZED ({near(k)})")
        steps.append(f"""b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.q, b.q) AS q FROM b{k} b LEFT JOIN (
  SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM (
    SELECT part, entry, i, sum(x) AS s, count(*) AS n FROM (SELECT a.part, a.entry, unnest(v.q) AS x, generate_subscripts(v.q, 1) AS i FROM a{k} a JOIN v USING (vec_id, part)) GROUP BY ALL) GROUP BY ALL) m USING (part, entry))""")
    steps.append(f"a{rounds} AS MATERIALIZED ({near(rounds)})")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})")
    steps.append(f"c AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(error) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN v0 USING (vec_id), h"


SQL = sql()
