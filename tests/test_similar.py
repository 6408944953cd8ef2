"""Frequent terms and the similarity join against plain versions."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sieveline.operators import similar

SF1 = "/root/testdata/sf0.1"


def grams(t):
    w = re.findall(r"[^\W]{2,}", (t or "").lower())
    return Counter(w) + Counter(map(" ".join, zip(w, w[1:])))


def some_texts(n, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    return [" ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.randint(0, 40))) for _ in range(n)] + ["", None, "w1", "w1 w2 w3"]


@pytest.mark.parametrize("threshold", [0.15, 0.4, 0.8])
def test_pairs_equal_all_pairs(spark, threshold):
    left, right = some_texts(80, 1), some_texts(40, 2)
    a = spark.createDataFrame([(k, t) for k, t in enumerate(left)], "i long, text string")
    b = spark.createDataFrame([(k, t) for k, t in enumerate(right)], "j long, text string")
    got = {(r.i, r.j): r.similarity for r in similar.similar_pairs(a, b, "i", "j", "text", threshold).collect()}
    all_ = [grams(t) for t in left + right]
    df = Counter(t for g in all_ for t in g)
    idf = {t: math.log((1 + len(all_)) / (1 + n)) + 1 for t, n in df.items()}

    def unit(g):
        v = {t: n * idf[t] for t, n in g.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    x, y = [unit(grams(t)) for t in left], [unit(grams(t)) for t in right]
    want = {(i, j): s for i, u in enumerate(x) for j, v in enumerate(y) if (s := sum(w * v.get(t, 0) for t, w in u.items())) >= threshold}
    assert want and got.keys() == {p for p, s in want.items() if abs(s - threshold) > 1e-9 or p in got}
    assert all(got[p] == pytest.approx(want[p]) for p in got)


def test_few_pairs_are_candidates(spark):
    """Over the driver's tables: under a twentieth of all pairs get as far as their vectors."""
    sides = []
    for table, key, name in (("documents", "doc_id", "i"), ("benchmark", "item_id", "j")):
        rows = spark.read.parquet(f"{SF1}/{table}.parquet").select(F.col(key).alias(name), "text")
        sides.append((rows.repartition(4), name, "text"))
    weights = similar.written(similar.idf(*sides), "idf")
    a, b = (similar.written(similar.tfidf(*s, weights), "vectors") for s in sides)
    found, _, _ = similar.candidates(a, b, 0.4)
    assert 0 < found.count() < 0.05 * sides[0][0].count() * sides[1][0].count()


def test_sketch_bounds():
    rng = random.Random(4)
    for counters in (1, 5, 50):
        own, true = similar.Sketch(counters), Counter()
        for _ in range(400):
            c = Counter(rng.choices(range(300), [1 / (k + 1) for k in range(300)], k=10))
            own.add(c)
            true.update(c)
        assert len(own.counts) <= 2 * counters + 10 and all(true[t] - own.error <= own.counts.get(t, 0) <= true[t] for t in true)


@pytest.mark.parametrize("counters", [2, 400, 100_000])
def test_idf_equals_a_full_count(spark, counters):
    """Few counters can't tell, some leave out most terms, very many leave out none: always the same terms."""
    texts = some_texts(300, 7) + ["only once here"] * 2
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "i long, text string").repartition(3)
    got = {r.term: r.df for r in similar.idf((df, "i", "text"), top=20, counters=counters).collect()}
    cf, n = Counter(), Counter()
    for t in texts:
        cf.update(grams(t))
        n.update(grams(t).keys())
    assert got == {t: n[t] for t, _ in sorted(cf.items(), key=lambda x: (-x[1], x[0]))[:20]}
    some = similar.frequent_terms([(df, "i", "text")], 20, counters)
    assert some is None if counters == 2 else 20 <= some.count() and (counters > 400 or some.count() < len(cf))
