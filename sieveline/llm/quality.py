"""Operator 9: quality rules and gradient-boosted trees over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, documents, fresh, smallest_by_hash

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "chars_per_word", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "bar_share", "distinct_share", "words_per_line")
#: -1: a larger value never raises the score.
MONOTONE = {"symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "bar_share": -1, "mark_share": -1}
_SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\v\f\r"


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that the text holds twice or more, the first included."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1].astype(np.int64)
    _, at, n = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    start = np.flatnonzero(n[at] > 1)
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[start + k] = True
    return int(hit.sum())


def statistics(text: str | None) -> tuple[tuple[int, ...], list[float]]:
    """COUNTS and FEATURES of a whole text; null is empty."""
    text = text or ""
    words = text.encode().split()  # at the six ASCII space characters
    spaces = sum(map(text.count, _SPACE))
    lines, seen, dup, full = text.split("\n"), set(), 0, 0
    for line in lines:
        if line.strip(_SPACE):
            full += 1
            dup += line in seen
            seen.add(line)
    n, chars = len(words), len(text) - spaces
    symbols, repeat = sum(map(text.count, _SYMBOLS)), repeated_words(words)
    ascii_ = np.frombuffer(text.encode(), np.uint8)
    upper = int(((ascii_ >= 65) & (ascii_ <= 90)).sum())
    digits = int(((ascii_ >= 48) & (ascii_ <= 57)).sum())
    w, c = max(n, 1), max(chars, 1)
    features = [np.log1p(n), chars / w, symbols / w, dup / max(full, 1), repeat / w, upper / c, digits / c, (text.count("!") + text.count("?")) / w, text.count("|") / w, len(set(words)) / w, n / max(full, 1)]
    return (n, chars, symbols, dup, repeat), [float(x) for x in features]


@dataclass
class Trees:
    """Node arrays of all trees, one after the other; a leaf points to itself. Scores are log odds."""

    base: float
    root: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of the rows of x, all rows and trees at once."""
        at = np.repeat(self.root[None, :], len(x), 0)
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(1)


def fit_trees(x: np.ndarray, y: np.ndarray, signs: np.ndarray, n_trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 48, l2: float = 1.0, least: int = 10) -> Trees:
    """Gradient-boosted trees for a 0/1 target with the logistic loss, on quantile histograms.

    signs has -1, 0 or 1 by feature. A split on a feature with a sign must put its children's values in that order,
    and their subtrees stay on their side of the middle between them, so the score is monotonic in the feature.
    """
    if not len(y):
        return _trees(0.0, [], [], depth)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(cuts, x.T, strict=True)], 1)
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(prior / (1 - prior)))
    f, nodes, roots = np.full(len(y), base), [], []
    value = lambda g, h, lo, hi: np.clip(-g / (h + l2), lo, hi)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, lo: float, hi: float) -> int:
        k = len(nodes)
        own = float(value(g[rows].sum(), h[rows].sum(), lo, hi))
        nodes.append([0, np.inf, k, k, own * rate])
        best = (1e-6, -1, -1)
        if level < depth and len(rows) >= 2 * least:
            total_g, total_h = g[rows].sum(), h[rows].sum()
            gain_of = lambda gs, hs, v: -(gs * v + 0.5 * (hs + l2) * v * v)
            for j, e in enumerate(cuts):
                if not len(e):
                    continue
                b = binned[rows, j]
                gl, hl, nl = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g[rows], h[rows], None))
                vl, vr = value(gl, hl, lo, hi), value(total_g - gl, total_h - hl, lo, hi)
                gain = gain_of(gl, hl, vl) + gain_of(total_g - gl, total_h - hl, vr) - gain_of(total_g, total_h, own)
                bad = (nl < least) | (len(rows) - nl < least) | ((vr - vl) * signs[j] < 0)
                gain[bad] = -1
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (float(gain[at]), j, at)
        if best[1] >= 0:
            _, j, at = best
            go = binned[rows, j] <= at
            left, right = rows[go], rows[~go]
            lo_l, hi_l, lo_r, hi_r = lo, hi, lo, hi
            if signs[j]:
                middle = float(value(g[left].sum(), h[left].sum(), lo, hi) + value(g[right].sum(), h[right].sum(), lo, hi)) / 2
                lo_l, hi_l, lo_r, hi_r = (lo, middle, middle, hi) if signs[j] > 0 else (middle, hi, lo, middle)
            nodes[k][0], nodes[k][1] = j, float(cuts[j][at])
            nodes[k][2] = grow(left, g, h, level + 1, lo_l, hi_l)
            nodes[k][3] = grow(right, g, h, level + 1, lo_r, hi_r)
        return k

    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-f))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
        f = _trees(base, roots, nodes, depth).score(x)
    return _trees(base, roots, nodes, depth)


def _trees(base: float, roots: list[int], nodes: list[list], depth: int) -> Trees:
    feature, threshold, left, right, value = (np.array(c) for c in zip(*nodes, strict=True)) if nodes else [np.zeros(0)] * 5
    return Trees(base, np.array(roots, int), feature.astype(int), threshold.astype(float), left.astype(int), right.astype(int), value.astype(float), depth)


STATISTICS = "struct<" + ",".join(f"{c}:long" for c in COUNTS) + ",features:array<double>>"


def _statistics(texts: pa.Array) -> pa.Array:
    rows = [statistics(t) for t in texts.to_pylist()]
    counts = np.array([c for c, _ in rows], np.int64).reshape(-1, len(COUNTS))
    return pa.StructArray.from_arrays([*(pa.array(c) for c in counts.T), pa.array([f for _, f in rows], pa.list_(pa.float64()))], [*COUNTS, "features"])


def statistics_of(text: str | F.Column):
    """The column of a text's statistics, STATISTICS."""
    return F.arrow_udf(_statistics, STATISTICS)(text)


def scorer(trees: Trees):
    """An Arrow function from features to the probability of good quality."""

    def score(features: pa.Array) -> pa.Array:
        x = features.flatten().to_numpy(zero_copy_only=False).reshape(len(features), -1)
        return pa.array(1 / (1 + np.exp(-trees.score(x))) if len(x) else np.zeros(0))

    return F.arrow_udf(score, "double")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = 2500) -> Trees:
    """Fits trees on a bounded sample: of each class the `per_class` labelled rows whose key has the smallest hash.

    Rows without label, key or text don't train; of repeated labels of a key the smallest holds, of repeated texts of a
    key that with the smallest hash.
    """
    known = labels.where(F.col(label).isin(0, 1)).groupBy(key).agg(F.min(label).alias("y")).where(F.col(key).isNotNull())
    chosen = smallest_by_hash(known.select(F.col(key).alias("key"), "y"), "y", "key", per_class).select("key", "y")
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = rows.join(F.broadcast(chosen), "key").groupBy("key", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    got = rows.select("key", "y", statistics_of("text").alias("s")).select("key", "y", "s.features").toPandas().sort_values("key")  # at most 2 * per_class rows
    x = np.array(got.features.tolist(), float).reshape(-1, len(FEATURES))
    return fit_trees(x, got.y.to_numpy(float), np.array([MONOTONE.get(f, 0) for f in FEATURES]))


def assess(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """Adds COUNTS, base_failed, quality_score and kept to docs.

    base_failed: under 50 words, or over half of the words in repeated 3-word windows. kept: base passed and the
    trees' probability of good quality is at least `least`. A null text counts as empty and fails. Repeated rows are
    assessed each; without labels the probability is 0.5; an empty table gives no rows; columns of these names that
    docs has already are replaced, others stay. A very long text is counted whole, within one task.
    """
    bound_batches(docs.sparkSession)
    trees = train(docs, labels, key, text)
    s = fresh(docs, "s")
    out = docs.withColumn(s, statistics_of(text))
    for c in COUNTS:
        out = out.withColumn(c, F.col(s)[c])
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    out = out.withColumn("quality_score", scorer(trees)(F.col(s)["features"])).drop(s)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality_score") >= least))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return assess(documents(spark, sf_dir).select("doc_id", "text"), labels).select("doc_id", *COUNTS, "base_failed", "kept")
