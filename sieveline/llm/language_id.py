"""Operator 2: language identification.

Sparse multinomial logistic regression on TF-IDF character n-grams, trained with follow-the-regularised-leader and an
elastic-net penalty, then calibrated by a temperature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, documents, fresh, smallest_by_hash, tidy

#: Buckets that character n-grams are hashed to, and the lengths of the n-grams.
BITS, GRAMS = 16, (1, 2, 3)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SLICE = 1 << 18


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of a whole text's n-grams of lower-case characters; runs of white space are one space."""
    text = " ".join(text.lower().split())
    total = None
    for at in range(0, max(len(text), 1), _SLICE):
        code = np.frombuffer(text[at : at + _SLICE + max(GRAMS) - 1].encode("utf-32-le"), "<u4").astype(np.uint64)
        new, found, gram = min(_SLICE, len(text) - at), [], np.zeros(len(code), np.uint64)
        for n in GRAMS:
            if len(code) < n:
                break
            gram = gram[: len(code) - n + 1] * np.uint64(0x100000001B3) + code[n - 1 :] + np.uint64(n)
            found.append(((gram[:new] * _ODD) >> np.uint64(64 - BITS)).astype(np.int64))
        counts = np.bincount(np.concatenate(found) if found else np.empty(0, np.int64), minlength=1 << BITS)
        total = counts if total is None else total + counts
    at = np.flatnonzero(total)
    return at, total[at]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    """languages, idf by bucket, weights by bucket and language, bias, temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return tf_idf(counts, self.idf[at]) @ self.weights[at] + self.bias


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf
    return x / max(np.sqrt(x @ x), 1e-12)


def document_frequencies(df: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Over all rows of df: in how many texts each bucket occurs, and how many texts there are. The result has a bounded size."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen[gram_counts(t)[0]] += 1
                n += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([n, *seen[at].tolist()], pa.int64())], ["bucket", "n"])

    counts = df.select(text).mapInArrow(tidy(partial), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros(1 << BITS, np.int64)
    real = counts[counts.bucket >= 0]
    seen[real.bucket.to_numpy(np.int64)] = real.n.to_numpy(np.int64)
    return seen, int(counts.n[counts.bucket < 0].sum())


def snippet(text: str) -> str:
    """One, two, four or eight words in a row, where a hash of the text says."""
    found = text.split()
    h = xxhash.xxh3_64_intdigest(text)
    n = 1 << (h % 4)
    at = (h >> 2) % max(1, len(found) - n + 1)
    return " ".join(found[at : at + n])


def _packed_grams(texts: pa.Array) -> pa.Array:
    rows = [(*gram_counts(t), *gram_counts(snippet(t))) for t in texts.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([c.astype("<i4").tobytes() for c in column], pa.binary()) for column in (zip(*rows, strict=True) if rows else ((),) * 4)], ["at", "n", "at_snippet", "n_snippet"])


def packed_grams():
    """An Arrow function from texts to buckets and counts, as little-endian 32-bit integers, of each and of a snippet of it; small to collect."""
    return F.arrow_udf(_packed_grams, "struct<at:binary,n:binary,at_snippet:binary,n_snippet:binary>")


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int, width: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """Follow-the-regularised-leader, per coordinate: weights by feature and class, and the bias."""
    z, n = np.zeros((width + 1, k)), np.zeros((width + 1, k))

    def leader(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            at, x = np.append(at, width), np.append(x, 1.0)
            zi, ni = z[at], n[at]
            w = leader(zi, ni)
            g = np.outer(x, _softmax(x @ w) - (np.arange(k) == y[i]))
            root = np.sqrt(ni + g * g)
            z[at] = zi + g - (root - np.sqrt(ni)) / alpha * w
            n[at] = ni + g * g
    w = leader(z, n)
    return w[:-1].astype(np.float32), w[-1].astype(np.float32)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, on a log-spaced grid from 0.002 to 50.

    Targets are smoothed by Platt's rule, (n + 1) / (n + 2) for n rows, so that rows that are all right don't ask for
    certainty.
    """
    n, k = logits.shape
    if not n or k < 2:
        return 1.0
    target = np.full((n, k), 1 / (n + 2) / (k - 1))
    target[np.arange(n), y] = (n + 1) / (n + 2)

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(1, keepdims=True)
        return float((target * (np.log(np.exp(z).sum(1, keepdims=True)) - z)).sum(1).mean())

    return float(min(np.geomspace(0.002, 50, 201), key=loss))


def train(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 1200, epochs: int = 2, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.005, l2: float = 0.005) -> Model:
    """Learns from the rows of df with a language and a text.

    Document frequencies count all rows. Weights and temperature are fitted on a bounded sample: of each language the
    `per_language` rows whose key has the smallest hash, of which every fifth goes to the temperature: the whole text
    and a snippet of a few words, as whole texts alone may all be told apart. Of rows that share key and language one is
    taken, that whose text has the smallest hash; ties of hashes go by key.
    """
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    seen, n = document_frequencies(rows, "text")
    idf = np.log((1 + n) / (1 + seen)) + 1
    digest = F.xxhash64("text")
    distinct = rows.groupBy("key", "lang").agg(F.min(digest).alias("digest"))
    chosen = smallest_by_hash(distinct, "lang", "key", per_language).join(distinct, ["key", "lang"])
    # At most per_language rows a language and MOST_CLASSES languages; repeats go before their n-grams are counted.
    sample = rows.withColumn("digest", digest).join(F.broadcast(chosen), ["key", "lang", "digest"]).dropDuplicates(["key", "lang"])
    got = sample.withColumn("g", packed_grams()("text")).select("key", "lang", "k", "g.*").toPandas().sort_values(["lang", "k"])
    languages = sorted(set(got.lang))
    if not languages:
        return Model([], idf, np.zeros((1 << BITS, 0), np.float32), np.zeros(0, np.float32))
    y = np.array([languages.index(x) for x in got.lang])

    def vectors(at: str, n: str) -> list[tuple[np.ndarray, np.ndarray]]:
        pairs = [(np.frombuffer(a, "<i4").astype(np.int64), np.frombuffer(c, "<i4")) for a, c in zip(got[at], got[n], strict=True)]
        return [(a, tf_idf(c, idf[a])) for a, c in pairs]

    x, short = vectors("at", "n"), vectors("at_snippet", "n_snippet")
    held = got.k.to_numpy() % 5 == 0
    fit = [i for i in range(len(x)) if not held[i]]
    weights, bias = fit_ftrl([x[i] for i in fit], y[fit], len(languages), 1 << BITS, epochs, alpha, beta, l1, l2)
    logits = [v @ weights[a] + bias for some in (x, short) for (a, v), h in zip(some, held, strict=True) if h]
    return Model(languages, idf, weights, bias, fit_temperature(np.array(logits, float).reshape(-1, len(languages)), np.tile(y[held], 2)))


def predictor(model: Model):
    """An Arrow function from texts to struct(lang, score): the likeliest language and its calibrated probability.

    `und` with score 0 where a text is null or has no letter, or no language was learned.
    """

    @F.arrow_udf("struct<lang:string,score:double>")
    @tidy
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from map(predicted, batches)

    def predicted(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        for t in texts.to_pylist():
            if not has_letter(t) or not model.languages:
                langs.append("und")
                scores.append(0.0)
                continue
            p = _softmax(model.logits(*gram_counts(t)).astype(float) / model.temperature)
            k = int(p.argmax())
            langs.append(model.languages[k])
            scores.append(min(1.0, float(p[k])))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return predict


def held_out(key: str = "doc_id") -> "Column":  # noqa: F821
    """True where the CRC-32 of the key as text leaves 2 when divided by 4; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def identify(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """Adds held_out, lang_pred and score to df, having learned from its rows that aren't held out.

    Rows without key don't train. Repeated rows are predicted each; an empty table gives no rows; columns of these
    three names that df has already are replaced, others stay. Prediction reads the text alone, and a very long one
    whole, in slices; of languages with the same probability the first by name is taken.
    """
    bound_batches(df.sparkSession)
    model = train(df.where(~held_out(key) & F.col(key).isNotNull()), text, lang, key)
    p = fresh(df, "p")
    out = df.withColumn(p, predictor(model)(F.col(text))).withColumn("held_out", held_out(key))
    return out.withColumn("lang_pred", F.col(p)["lang"]).withColumn("score", F.col(p)["score"]).drop(p)


def accepted(df: DataFrame, least: float, text: str = "text", lang: str = "lang", key: str = "doc_id") -> F.Column:
    """A condition on df's rows: the text has a letter and its likeliest language a calibrated score of `least` or more."""
    bound_batches(df.sparkSession)
    model = train(df.where(~held_out(key) & F.col(key).isNotNull()), text, lang, key)
    return predictor(model)(F.col(text))["score"] >= least


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir).select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")
