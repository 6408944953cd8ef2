"""Pairs of similar texts: TF-IDF of the most frequent n-grams, and a similarity join that is bounded by what texts hold apart."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import written
from .ordering import spread

#: Terms that a task counts at a time in the sketch: some 60 MB.
COUNTERS = 250_000
#: Texts whose terms a worker holds at a time, and characters of them; a longer text is held alone.
SLICE_ROWS, SLICE_CHARS = 256, 1 << 19
#: Rows of a table that may be broadcast.
MOST_BROADCAST = 1 << 20


def _grams(words: list[str] | None) -> list[Counter]:
    words = words or []
    return [Counter(words), Counter(map(" ".join, zip(words, words[1:])))]


def slices(texts: pa.Array, rows: int = SLICE_ROWS, chars: int = SLICE_CHARS) -> Iterator[list[str | None]]:
    """The texts of an Arrow batch, which holds thousands of them, a few at a time."""
    at, sizes = 0, pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    while at < len(texts):
        to, size = at + 1, sizes[at]
        while to < len(texts) and to - at < rows and size + sizes[to] <= chars:
            size += sizes[to]
            to += 1
        yield texts.slice(at, to - at).to_pylist()
        at = to


def _counted_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, joined words): (key, term, tf) of their distinct 1- and 2-grams, a batch for each slice."""
    for batch in batches:
        at = 0
        for texts in slices(batch.column(1)):
            terms, n, owner = [], [], []
            for k, t in enumerate(texts, at):
                for c in _grams(_split(t)):
                    terms += c.keys()
                    n += c.values()
                    owner += [k] * len(c)
            at += len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(terms, pa.string()), pa.array(n, pa.int32())], [batch.schema.names[0], "term", "tf"])


def _split(joined: str | None) -> list[str] | None:
    return joined.split(" ") if joined else None


def words_of(text: str):
    """Words of two letters, digits or underscores at least, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf) of word 1- and 2-grams: a text's row is counted where it stands."""
    rows = docs.select(key, F.array_join(words_of(text), " ").alias("words"))
    return rows.mapInArrow(_counted_slices, T.StructType([rows.schema[key], T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType())]))


class Sketch:
    """Counts of the more frequent terms with a bounded number of counters (Misra and Gries): never too high, and too low by `error` at most."""

    def __init__(self, counters: int):
        self.counters, self.counts, self.error = counters, Counter(), 0

    def add(self, terms: Counter) -> None:
        self.counts.update(terms)
        if len(self.counts) > 2 * self.counters:
            n = np.fromiter(self.counts.values(), np.int64, len(self.counts))
            off = int(np.partition(n, len(n) - self.counters - 1)[len(n) - self.counters - 1])
            self.counts = Counter({t: c - off for t, c in self.counts.items() if c > off})
            self.error += off


def frequent_terms(sides: list[tuple[DataFrame, str, str]], top: int, counters: int = COUNTERS) -> DataFrame | None:
    """(term): all that may be among the `top` terms by frequency, as a table; None where the sketches can't tell.

    A task leaves at most 2 * counters terms, each with a count that is too low by its error at most, so errors add up to
    a bound for every term. With L the top-th of the added counts, that many terms occur L times or more; so a term of
    the true top does too, and its added count is L less the bound or more. Where that is 0 or less, terms that no task
    kept might belong to them, and the caller has to count all.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Sketch(counters)
        for batch in batches:
            for texts in slices(batch.column(0)):
                for t in texts:
                    for c in _grams(_split(t)):
                        own.add(c)
        yield pa.RecordBatch.from_arrays([pa.array([None, *own.counts]), pa.array([own.error, *own.counts.values()], pa.int64())], ["term", "n"])

    rows = None
    for docs, _, text in sides:
        part = docs.select(F.array_join(words_of(text), " ").alias("w")).mapInArrow(sketch, "term string, n long")
        rows = part if rows is None else rows.unionByName(part)
    low = written(rows.groupBy("term").agg(F.sum("n").alias("n")), "term-sketch")
    error = low.where("term is null").first()
    last = low.where("term is not null").select("n").orderBy(F.desc("n")).limit(top).agg(F.count("*").alias("found"), F.min("n").alias("n")).first()
    if error is None or error["n"] == 0 and last["found"] < top:
        return low.where("term is not null").select("term")  # nothing was left out
    if last["found"] < top or last["n"] <= error["n"]:
        return None
    return low.where((F.col("n") >= last["n"] - error["n"]) & F.col("term").isNotNull()).select("term")


def counted(sides: list[tuple[DataFrame, str, str]], top: int, counters: int = COUNTERS) -> list[DataFrame]:
    """For each side (rows, key, text) a table (key, term, tf) of the terms that may be among the `top` of all sides; of all terms where sketches can't tell."""
    some, out = frequent_terms(sides, top, counters), []
    for docs, key, text in sides:
        rows = term_counts(docs, key, text)
        if some is not None:
            rows = rows.join(F.broadcast(some) if some.count() <= MOST_BROADCAST else some, "term")
        out.append(written(rows.select(key, "term", "tf"), "term-counts"))
    return out


def weights_of(counts: list[DataFrame], sides: list[tuple[DataFrame, str, str]], top: int) -> DataFrame:
    """(term, idf, df) of the `top` terms by frequency, ties by term."""
    terms, n = counts[0].select("term", "tf"), sides[0][0].select(F.count("*").alias("n"))
    for c, s in zip(counts[1:], sides[1:], strict=True):
        terms, n = terms.union(c.select("term", "tf")), n.union(s[0].select(F.count("*").alias("n")))
    kept = terms.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df")).orderBy(F.desc("cf"), "term").limit(top)
    return kept.crossJoin(F.broadcast(n.agg(F.sum("n").alias("n")))).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"), "df")


def idf(*sides: tuple[DataFrame, str, str], top: int = 10_000, counters: int = COUNTERS) -> DataFrame:
    """(term, idf, df) of the `top` terms by frequency (ties by term) in the texts of all sides (rows, key, text) together.

    Sketches find which terms may be among them, and these alone are counted and dealt; see frequent_terms. Where
    sketches can't tell, all terms are.
    """
    return weights_of(counted(list(sides), top, counters), list(sides), top)


def unit_vectors(counts: DataFrame, key: str, weights: DataFrame) -> DataFrame:
    """(key, v): L2-normalised TF-IDF of rows (key, term, tf) as an array of (term, w, df), by the terms of `weights`, which idf bounds in number; one shuffle, by key."""
    w = counts.join(F.broadcast(weights), "term").select(key, "term", "df", (F.col("tf") * F.col("idf")).alias("w"))
    each = w.groupBy(key).agg(F.collect_list(F.struct("term", "w", "df")).alias("v"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return each.select(key, F.transform("v", lambda x: F.struct(x["term"].alias("term"), (x["w"] / F.col("norm")).alias("w"), x["df"].alias("df"))).alias("v"))


def tfidf(docs: DataFrame, key: str, text: str, weights: DataFrame) -> DataFrame:
    """unit_vectors of texts."""
    return unit_vectors(term_counts(docs, key, text), key, weights)


def candidates(left: DataFrame, right: DataFrame, threshold: float, share: float = 0.6) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates (i, j, part), rests of the left (i, v), rests of the right (j, v)) of vectors (i, v) and (j, v).

    Of a right-hand vector the terms that most texts hold for their weight are left out, as long as what is left out
    has a norm under `share` of the threshold. What remains, its prefix, is the inverted index: `part` is the product
    over these terms. A left-hand vector's rest are its terms that some prefix leaves out. What a pair can have besides
    `part` is at most the product of the two rests' norms; a pair that can't reach the threshold is no candidate, and a
    pair that shares no term with a prefix never can, as no vector is longer than 1.
    """
    cost = lambda x: x["df"] / (x["w"] * x["w"])
    ranked = right.select("j", F.array_sort(F.transform("v", lambda x: F.struct((-cost(x)).alias("cost"), x["term"].alias("term"), x["w"].alias("w")))).alias("v"))
    w = Window.partitionBy("j").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    spent = ranked.select("j", F.posexplode("v").alias("place", "x")).withColumn("mass", F.sum(F.col("x.w") * F.col("x.w")).over(w))
    out = F.col("mass") < (share * threshold) ** 2
    parts = written(spent.select("j", "x.term", "x.w", out.alias("is_rest"), F.max(F.when(out, F.col("mass"))).over(Window.partitionBy("j")).alias("mass")), "prefixes")
    right_rest = parts.where("is_rest").groupBy("j").agg(F.collect_list(F.struct("term", "w")).alias("v"))
    common = parts.where("is_rest").select("term").distinct().withColumn("common", F.lit(True))  # of weights' terms, so bounded as they are
    terms = left.select("i", F.inline("v")).select("i", "term", "w").join(F.broadcast(common), "term", "left")
    square = F.when(F.col("common"), F.col("w") * F.col("w")).otherwise(0.0)
    terms = terms.withColumn("own", F.sqrt(F.sum(square).over(Window.partitionBy("i"))))
    left_rest = terms.where("common").groupBy("i").agg(F.collect_list(F.struct("term", "w")).alias("v"))
    index = parts.where("not is_rest").select("j", "term", F.col("w").alias("wj"), F.sqrt(F.coalesce("mass", F.lit(0.0))).alias("other"))
    met = terms.join(index, "term").groupBy("i", "j").agg(F.sum(F.col("w") * F.col("wj")).alias("part"), F.first("own").alias("own"), F.first("other").alias("other"))
    return met.where(F.col("part") + F.col("own") * F.col("other") >= threshold - 1e-9).select("i", "j", "part"), left_rest, right_rest


def similar_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, text: str, threshold: float, top: int = 10_000) -> DataFrame:
    """(left_key, right_key, similarity) at or over the threshold: cosine of TF-IDF fitted on both sides together. Keys are unique.

    The right-hand side is the one that is indexed, so pass the smaller one there. Candidates carry ids and what is
    known of their product; the rests of their vectors, terms that many texts hold, meet once for each to complete it.
    """
    sides = [(spread(df.select(F.col(k).alias(name), F.col(text).alias("text"))), name, "text") for df, k, name in ((left, left_key, "i"), (right, right_key, "j"))]
    counts = counted(sides, top)  # texts are read twice: for the sketches, and to count
    weights = written(weights_of(counts, sides, top), "idf")  # at most `top` rows
    a, b = (written(unit_vectors(c, s[1], weights), "vectors") for c, s in zip(counts, sides, strict=True))
    pairs, own, other = candidates(a, b, threshold)
    both = pairs.join(own.withColumnRenamed("v", "x"), "i", "left").join(other.withColumnRenamed("v", "y"), "j", "left")
    weight = F.map_from_entries(F.transform("x", lambda t: F.struct(t["term"], t["w"])))
    rest = F.aggregate("y", F.lit(0.0), lambda s, t: s + t["w"] * F.coalesce(F.try_element_at(weight, t["term"]), F.lit(0.0)))
    scored = both.select("i", "j", (F.col("part") + F.coalesce(rest, F.lit(0.0))).alias("similarity"))
    return scored.where(F.col("similarity") >= threshold).select(F.col("i").alias(left_key), F.col("j").alias(right_key), "similarity")


def similarity_counts(pairs: DataFrame, *levels: float) -> DataFrame:
    """(level, n_pairs): how many pairs are over each level."""
    counts = pairs.agg(*(F.count_if(F.col("similarity") > x).alias(str(k)) for k, x in enumerate(levels)))
    rows = F.array(*(F.struct(F.lit(x).alias("level"), F.col(str(k)).alias("n_pairs")) for k, x in enumerate(levels)))
    return counts.select(F.inline(rows))
