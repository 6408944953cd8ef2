"""Operator 12: exact top-k by inner product, term at a time over postings in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, written
from .vectors import quantised

#: A block: some rows by term. ids and uids have a value per row; a term's postings are rows[ends[t - 1]:ends[t]] and their weights.
BLOCK = "is_query boolean, part int, seq int, n int, ids array<long>, first_uid long, uids binary, terms binary, ends binary, rows binary, weights binary"
#: Queries whose scores are added up together: their score arrays stay in a core's cache.
STRIP = 32


def postings(values: np.ndarray, held: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """(terms, ends, rows, weights) of a matrix with a row per vector, of the components that aren't 0; `held` says which a vector has."""
    term, row = np.nonzero((values != 0).T & held.T)
    terms, n = np.unique(term, return_counts=True)
    return terms.astype("<i4").tobytes(), np.cumsum(n).astype("<i4").tobytes(), row.astype("<u2").tobytes(), values[row, term].astype("<i8").tobytes()


def packer(key: str, vector: str, scale: int, queries_by: int, block_rows: int, query_rows: int):
    """A mapInArrow function: rows (key, vector) to BLOCKs of candidates and, of the same rows, of queries."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seq, uid = 0, part << 33
        schema = pa.schema([("is_query", pa.bool_()), ("part", pa.int32()), ("seq", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int64())), ("first_uid", pa.int64()), *((c, pa.binary()) for c in ("uids", "terms", "ends", "rows", "weights"))])
        waiting: dict[bool, list] = {False: [], True: []}

        def flush(kind: bool) -> Iterator[pa.RecordBatch]:
            nonlocal seq
            rows, waiting[kind] = waiting[kind], []
            if rows:
                # In order of id (null last), so that ties within a block go to the smaller one.
                rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
                width = max(len(v) for _, _, v in rows)
                values, held = np.zeros((len(rows), width), np.int64), np.zeros((len(rows), width), bool)
                for i, (_, _, v) in enumerate(rows):
                    values[i, : len(v)], held[i, : len(v)] = v, True
                uids = np.array([u for _, u, _ in rows], "<i8").tobytes()
                cells = [kind, part, seq, len(rows), [k for k, _, _ in rows], rows[0][1], uids, *postings(values, held)]
                yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, schema, strict=True)], schema=schema)
                seq += 1

        for batch in batches:
            keys = batch.column(key).to_pylist()
            for i, v in quantised(batch.column(vector), scale):
                waiting[False].append((keys[i], uid, v))
                if keys[i] is not None and keys[i] % queries_by == 0:
                    waiting[True].append((keys[i], uid, v))
                uid += 1
                # Blocks are bounded by components as well as by rows, whatever the dimension.
                for kind, most in ((False, block_rows), (True, query_rows)):
                    if len(waiting[kind]) >= min(most, max(1, (1 << 19) // max(1, len(v)))):
                        yield from flush(kind)
        yield from flush(False)
        yield from flush(True)

    return pack


class Block:
    def __init__(self, row: dict):
        self.n, self.ids = row["n"], row["ids"]
        self.order = np.array([(1 << 63) - 1 if k is None else k for k in self.ids], np.int64)
        self.uids = np.frombuffer(row["uids"], "<i8")
        terms, ends = np.frombuffer(row["terms"], "<i4").tolist(), np.frombuffer(row["ends"], "<i4").tolist()
        rows, weights = np.frombuffer(row["rows"], "<u2").astype(np.int64), np.frombuffer(row["weights"], "<i8")
        self.by_term = {t: (rows[a:b], weights[a:b]) for t, a, b in zip(terms, [0, *ends], ends, strict=False)}
        self.largest = {t: int(np.abs(w).max()) for t, (_, w) in self.by_term.items()}


def scores(queries: Block, candidates: Block) -> np.ndarray:
    """Inner products of all queries with all candidates of two blocks, by scattering weighted postings into score arrays."""
    shared = [t for t in queries.by_term if t in candidates.by_term]
    bound = sum(queries.largest[t] * candidates.largest[t] for t in shared)
    if bound >= 1 << 63:
        raise ValueError("inner products don't fit into 64 bits")
    kind = np.float64 if bound < 1 << 53 else np.int64  # sums of integers under 2^53 are exact in doubles
    out = np.zeros((queries.n, candidates.n), kind)
    for at in range(0, queries.n, STRIP):
        strip = out[at : at + STRIP]
        for t in shared:
            q, qw = queries.by_term[t]
            a, b = np.searchsorted(q, (at, at + len(strip)))
            if a == b:
                continue
            rows, weights = candidates.by_term[t]
            add = np.multiply.outer(qw[a:b].astype(kind), weights.astype(kind))
            if b - a == len(strip) and len(rows) == candidates.n:
                strip += add
            elif len(rows) == candidates.n:
                strip[q[a:b] - at] += add
            else:
                strip[(q[a:b] - at)[:, None], rows] += add
    return out.astype(np.int64)


def _best(score: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of equally long arrays, ties to the smaller order, then to the earlier place: by partition, then a sort of what is left."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= least)
    else:
        near = np.arange(len(score))
    return near[np.lexsort((near, order[near], -score[near]))[:k]]


def searcher(k: int):
    """A mapInArrow function over units, each its queries' blocks first and then its candidates': the k best of each query in a unit."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, queries, best = None, [], []
        names = ["query_uid", "query_id", "uid", "vec_id", "score"]

        def found() -> Iterator[pa.RecordBatch]:
            for block, top in zip(queries, best, strict=True):
                cells: list[list] = [[], [], [], [], []]
                for i, (score, order, uid) in enumerate(top):
                    m = len(score)
                    for c, x in zip(cells, ([int(block.uids[i])] * m, [block.ids[i]] * m, uid.tolist(), order.tolist(), score.tolist()), strict=True):
                        c += x
                cells[3] = [None if x == (1 << 63) - 1 else x for x in cells[3]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cells], names)

        for batch in batches:
            for row in batch.to_pylist():
                if (row["lane"], row["unit"]) != unit:
                    yield from found()
                    unit, queries, best = (row["lane"], row["unit"]), [], []
                block = Block(row)
                if row["is_query"]:
                    queries.append(block)
                    best.append([(np.empty(0, np.int64),) * 3] * block.n)
                    continue
                for q, top in zip(queries, best, strict=True):
                    s = scores(q, block)
                    for i in range(q.n):
                        mine, others = s[i], block.uids != q.uids[i]  # a query isn't its own answer
                        order, uids = block.order, block.uids
                        if not others.all():
                            mine, order, uids = mine[others], order[others], uids[others]
                        if len(top[i][0]) == k:  # only what may come before the last so far
                            near = mine >= top[i][0][-1]
                            if not near.any():
                                continue
                            mine, order, uids = mine[near], order[near], uids[near]
                        at = _best(mine, order, k)
                        joined = [np.concatenate(x) for x in zip(top[i], (mine[at], order[at], uids[at]), strict=True)]
                        keep = np.lexsort((joined[2], joined[1], -joined[0]))[:k]
                        top[i] = tuple(x[keep] for x in joined)
        yield from found()

    return search


def top_k(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10, queries_by: int = 100, scale: int = 1024, block_rows: int = 4096, query_rows: int = 256, lane_bytes: int = 16 << 20, unit_blocks: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row whose key is divisible by `queries_by` the k other rows with the largest inner product.

    Components are floor(scale * x). Rows are packed once into blocks of postings, candidates and queries alike, as a
    table. Queries are cut into lanes of bounded bytes, candidates into units of bounded blocks; each lane meets each
    unit in one stretch of a task, which holds the lane's queries and streams the unit's blocks past them, and leaves k
    rows per query and unit to merge. So every query meets every row, in blocks, and nothing is held whole.

    Ties go to the smaller key, a null key comes last. A row is no answer to itself; other rows with its key are. Rows
    that are equal are each a row: each is an answer, and each a query with answers of its own. Vectors that are null or
    hold a null or non-finite component take no part; a component that a shorter vector lacks counts 0; an empty table
    gives no rows; other columns, whatever their names, are not read. Scores must fit into 64 bits, or the query fails.
    """
    spark = df.sparkSession
    bound_batches(spark)
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    blocks = written(rows.mapInArrow(packer("key", "vector", scale, queries_by, min(block_rows, 1 << 16), query_rows), BLOCK), "postings")
    size = F.octet_length("weights") + F.octet_length("rows")
    n = blocks.agg(F.sum(F.when(F.col("is_query"), size)).alias("q"), F.count_if(~F.col("is_query")).alias("c")).first()
    lanes = max(1, -(-(n["q"] or 0) // lane_bytes))
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    units = max(1, -(-n["c"] // unit_blocks), min(n["c"], -(-parallel // lanes)))
    deal = lambda m: F.pmod(F.xxhash64("part", "seq"), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    own = blocks.where("is_query").withColumn("lane", deal(lanes)).withColumn("unit", each(units))
    others = blocks.where("not is_query").withColumn("unit", deal(units)).withColumn("lane", each(lanes))
    dealt = own.unionByName(others).repartition(lanes * units, "lane", "unit").sortWithinPartitions("lane", "unit", F.desc("is_query"), "part", "seq")
    near = dealt.mapInArrow(searcher(k), "query_uid long, query_id long, uid long, vec_id long, score long")
    w = Window.partitionBy("query_uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "uid")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY rank <= 10"""
