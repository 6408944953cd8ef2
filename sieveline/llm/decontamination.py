"""Operator 4: benchmark passages in documents.

1. Items become a table: shingles, a SimHash fingerprint, and for each block of its bits all values near it, under the
   item's length. A bit set of fixed size tells which shingles some item has.
2. One scan slides windows of every item length over the texts. A window that is similar enough to any item has nearly
   only shingles of items, which running sums over the bit set tell; such windows get fingerprints.
3. Windows and items meet in a join on length, block and block value: the multi-index gives all fingerprints within the
   radius. The weighted similarity of the word shingles then decides.

The benchmark may have any size: only the bit set and the distinct lengths of items go to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, documents, fresh, tidy, written
from .shingles import SHINGLE, mix, shingle_hashes, words

BITS, BLOCKS, RADIUS = 128, 8, 31
_WIDTH = BITS // BLOCKS
#: Bit patterns within RADIUS // BLOCKS of zero: a fingerprint within RADIUS differs by no more in one block at least.
NEAR = np.array([sum(1 << b for b in c) for k in range(RADIUS // BLOCKS + 1) for c in combinations(range(_WIDTH), k)], np.uint64)
_SALT = np.uint64(0xD6E8FEB86659FD93)
#: Bits that tell which shingles some item has.
SEEN = 1 << 22
_RUN = 4096


def signs(h: np.ndarray) -> np.ndarray:
    """+1 or -1 for each shingle and bit."""
    two = np.stack([mix(h), mix(h ^ _SALT)], 1)
    return np.unpackbits(two.view(np.uint8), axis=1).astype(np.int32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """BLOCKS numbers of _WIDTH bits for each row of summed signs; a tie gives a 0."""
    return np.packbits(sums > 0, axis=1).view(np.uint16)


def occurrences(h: np.ndarray) -> np.ndarray:
    """Each shingle hashed with the number of times it came before: a bag as a set, so that all features weigh the same."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    start = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    nth = np.empty(len(h), np.uint64)
    nth[order] = (np.arange(len(h)) - np.repeat(start, np.diff(np.append(start, len(h))))).astype(np.uint64)
    return np.where(nth == 0, h, mix(h + nth * np.uint64(0x9E3779B97F4A7C15)))


def window_prints(h: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    """Fingerprints of the windows of m shingles of h that start there, as bags.

    Running sums give those of windows without repeated shingles; the few others are summed on their own.
    """
    sums = np.vstack([np.zeros((1, BITS), np.int32), np.cumsum(signs(h), 0, dtype=np.int32)])
    out = fingerprints(sums[starts + m] - sums[starts])
    last: dict[int, int] = {}
    before = np.full(len(h), -1)
    for k, x in enumerate(h.tolist()):
        before[k] = last.get(x, -1)
        last[x] = k
    latest = np.maximum.accumulate(before)  # the latest place up to here whose shingle comes again by here
    for k in np.flatnonzero(latest[starts + m - 1] >= starts).tolist():
        out[k] = fingerprints(signs(occurrences(h[starts[k] : starts[k] + m])).sum(0, keepdims=True))[0]
    return out


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Of two bags of shingles, each weighted by how often it occurs: shared weight over joint weight."""
    both = len(a) + len(b)
    if not both:
        return 0.0
    at, n = np.unique(np.concatenate([a, b]), return_inverse=True)[1], len(a)
    shared = int(np.minimum(np.bincount(at[:n], minlength=both), np.bincount(at[n:], minlength=both)).sum())
    return shared / (both - shared)


def block_keys(n_words: int, prints: np.ndarray, near: np.ndarray = NEAR[:1]) -> np.ndarray:
    """For each fingerprint and block the keys of the values near its own, for items of n_words words."""
    at = (np.uint64(n_words) * np.uint64(BLOCKS) + np.arange(BLOCKS, dtype=np.uint64)) << np.uint64(_WIDTH)
    return (at[None, :, None] + (prints.astype(np.uint64)[:, :, None] ^ near[None, None, :])).reshape(len(prints), -1)


ITEMS = "item long, item_id long, n_words int, size int, shingles binary, print binary, keys array<long>"


def item_table(benchmark: DataFrame) -> DataFrame:
    """Rows of ITEMS; items without id or words are none, repeated ones are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, item_id, text in zip(*(batch.column(c).to_pylist() for c in ("item", "item_id", "text")), strict=True):
                if w := words(text):
                    h = shingle_hashes(w)
                    own = fingerprints(signs(occurrences(h)).sum(0, keepdims=True))
                    rows.append((item, item_id, len(w), min(SHINGLE, len(w)), h.tobytes(), own.tobytes(), block_keys(len(w), own, NEAR)[0].view(np.int64).tolist()))
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 7, types, strict=True)], [f.split()[0] for f in ITEMS.split(", ")])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    return written(rows.withColumn("item", F.xxhash64("item_id", "text")).mapInArrow(run, ITEMS), "items")


def seen_shingles(items: DataFrame) -> np.ndarray:
    """SEEN bits as bytes: set where some item's shingle falls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64) % np.uint64(SEEN)
            h = np.sort(h)
            at, start = np.unique(h >> np.uint64(6), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (h & np.uint64(63)), start) if len(h) else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(bits.view(np.int64))], ["at", "bits"])

    found = items.select("shingles").mapInArrow(run, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()  # at most SEEN / 64 rows
    out = np.zeros(SEEN // 64, np.uint64)
    out[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return out


RUNS = "t0 long, t1 long, n_words int, first int, m int, n_text int, hashes binary, starts binary, prints binary"


def windows(lengths: list[tuple[int, int]], seen: np.ndarray, least: float):
    """A mapInArrow function: (t0, t1, text) to RUNS, the windows of item lengths (n_words, size) that may be similar to an item.

    Windows that overlap stand in one row, of bounded length, with their shingles once.
    """
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    names = [f.split()[0] for f in RUNS.split(", ")]

    def of(text: str | None) -> Iterator[tuple]:
        w = words(text)
        for size in sorted({s for _, s in lengths}):
            if len(w) < size:
                continue
            h = shingle_hashes(w, size)
            at = h % np.uint64(SEEN)
            total = np.concatenate(([0], np.cumsum((seen[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1), dtype=np.int64)))
            for n in (n for n, s in lengths if s == size):
                whole = n - size + 1  # the item's shingles
                m = min(whole, len(h))
                # Shared weight s over (whole + m - s) is `least` or more only from here on; what is shared has been seen.
                need = math.ceil(least * (whole + m) / (1 + least) - 1e-9)
                if need > m or total[-1] < need:
                    continue
                starts = np.flatnonzero(total[m:] - total[:-m] >= need)
                for part in np.split(starts, np.flatnonzero(np.diff(starts) > m) + 1):
                    for k in range(0, len(part), _RUN):
                        own = part[k : k + _RUN]
                        if len(own):
                            run = h[own[0] : own[-1] + m]
                            yield n, int(own[0]), m, len(w), run.tobytes(), (own - own[0]).astype(np.uint32).tobytes(), window_prints(run, own - own[0], m).tobytes()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(t0, t1, *r) for t0, t1, text in zip(*(batch.column(c).to_pylist() for c in ("t0", "t1", "text")), strict=True) for r in of(text)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return search


def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of RUNS: (run, window, key) for each window's blocks."""
    for batch in batches:
        for run, n, prints in zip(*(batch.column(c).to_pylist() for c in ("run", "n_words", "prints")), strict=True):
            keys = block_keys(n, np.frombuffer(prints, np.uint16).reshape(-1, BLOCKS))
            window = np.repeat(np.arange(len(keys), dtype=np.int32), BLOCKS)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(keys.size, run, np.int64)), pa.array(window), pa.array(keys.ravel().view(np.int64))], ["run", "window", "key"])


def best_window(least: float):
    """An Arrow function over a run, an item and the windows that met: struct(similarity, first) of the best within the radius, of equal ones the first; null without one."""

    def run(hashes: pa.Array, starts: pa.Array, prints: pa.Array, m: pa.Array, first: pa.Array, shingles: pa.Array, own: pa.Array, met: pa.Array) -> pa.Array:
        out = []
        for h, s, p, m_, f, item, ip, ks in zip(*(c.to_pylist() for c in (hashes, starts, prints, m, first, shingles, own, met)), strict=True):
            h, s, item = np.frombuffer(h, np.uint64), np.frombuffer(s, np.uint32).astype(np.int64), np.frombuffer(item, np.uint64)
            ks = np.array(sorted(ks))
            apart = np.unpackbits((np.frombuffer(p, np.uint16).reshape(-1, BLOCKS)[ks] ^ np.frombuffer(ip, np.uint16)).view(np.uint8), axis=1).sum(1)
            best = None
            for k in ks[apart <= RADIUS].tolist():
                got = weighted_similarity(item, h[s[k] : s[k] + m_])
                if got >= least and (best is None or got > best[0]):
                    best = got, f + int(s[k])
            out.append(best and {"similarity": best[0], "first": best[1]})
        return pa.array(out, pa.struct([("similarity", pa.float64()), ("first", pa.int32())]))

    return F.arrow_udf(run, "struct<similarity:double,first:int>")


def digest(text: str) -> list[Column]:
    """Two numbers that stand for a text."""
    return [F.xxhash64(F.col(text)), F.xxhash64(F.lit("again"), F.col(text))]


def leak_table(docs: DataFrame, benchmark: DataFrame, text: str = "text", least: float = 0.8) -> DataFrame:
    """(t0, t1, item_id, first_word, n_words, similarity): the benchmark items that the texts with these digests hold.

    An item is held in a window of its length, or by a shorter text as a whole, where the similarity of the bags of
    five-word shingles in lower case (an item of fewer words is one shingle) is at least `least`. Of an item's windows
    the best is given, of equal ones the first. Null and empty texts hold none; items without id or words are none, and
    repeated items one; an empty benchmark, and an empty table, give no rows. A very long text is searched whole, by one
    task; columns with other names are not read.
    """
    bound_batches(docs.sparkSession)
    items = item_table(benchmark)
    lengths = sorted((r.n_words, r.size) for r in items.select("n_words", "size").distinct().collect())
    t0, t1 = digest(text)
    rows = docs.where(F.col(text).isNotNull()).select(t0.alias("t0"), t1.alias("t1"), F.col(text).alias("text"))
    runs = rows.mapInArrow(tidy(windows(lengths, seen_shingles(items), least)), RUNS)
    runs = written(runs.withColumn("run", F.xxhash64("t0", "t1", "n_words", "first")), "runs").dropDuplicates(["t0", "t1", "n_words", "first"])
    index = items.select("item", F.explode("keys").alias("key"))
    met = runs.select("run", "n_words", "prints").mapInArrow(probes, "run long, window int, key long").join(index, "key")
    met = met.groupBy("run", "item").agg(F.collect_set("window").alias("met"))  # a run has a bounded number of windows
    pairs = met.join(runs, "run").join(items.select("item", "item_id", "shingles", "print", F.col("n_words").alias("item_words")), "item").where("item_words = n_words")
    best = best_window(least)("hashes", "starts", "prints", "m", "first", "shingles", "print", "met")
    found = pairs.select("t0", "t1", "item", "item_id", F.least("n_words", "n_text").alias("n_words"), best.alias("b")).where("b is not null")
    one = found.groupBy("t0", "t1", "item", "item_id", "n_words").agg(F.max(F.struct("b.similarity", (-F.col("b.first")).alias("f"))).alias("b"))
    return written(one.select("t0", "t1", "item_id", (-F.col("b.f")).alias("first_word"), "n_words", "b.similarity"), "leaks")


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", least: float = 0.8) -> DataFrame:
    """Adds `leaks` to docs, what leak_table has of each row's text, by item; a column of that name is replaced."""
    found = leak_table(docs, benchmark, text, least)
    a, b = fresh(docs, "t0"), fresh(docs, "t1")
    held = found.groupBy(F.col("t0").alias(a), F.col("t1").alias(b)).agg(F.array_sort(F.collect_list(F.struct("item_id", "first_word", "n_words", "similarity"))).alias("leaks"))
    t0, t1 = digest(text)
    out = docs.drop("leaks").withColumn(a, t0).withColumn(b, t1).join(held, [a, b], "left").drop(a, b)
    none = F.array().cast(held.schema["leaks"].dataType)
    return out.withColumn("leaks", F.coalesce("leaks", none))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", least: float = 0.8) -> DataFrame:
    """The rows of docs whose text holds no benchmark item."""
    a, b = fresh(docs, "t0"), fresh(docs, "t1")
    held = leak_table(docs, benchmark, text, least).select(F.col("t0").alias(a), F.col("t1").alias(b)).distinct()
    t0, t1 = digest(text)
    return docs.withColumn(a, t0).withColumn(b, t1).join(held, [a, b], "left_anti").select(docs.columns)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = leak_table(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    t0, t1 = digest("text")
    return docs.select("doc_id", t0.alias("t0"), t1.alias("t1")).join(found, ["t0", "t1"]).drop("t0", "t1")
