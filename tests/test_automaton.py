"""Many patterns in one pass, against plain `in`."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sieveline.functions.automaton import Lexicon, Patterns
from sieveline.operators import curate

WORDS = ["a", "ab", "b c", "tax", "irs", "ïrs", "x", "", "taxi", "ax"]


def some_texts(n=300, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("ab ctxirsï\n.") for _ in range(rng.randint(0, 40))) for _ in range(n)] + [None, "", "tax" * 5000, "A TAXI"]


def test_found_and_any_equal_in(spark):
    texts = some_texts()
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    for words in (WORDS, WORDS[:3], [""], []):
        p = Patterns(words)
        got = {r.k: (r.f, r.a) for r in rows.select("k", p.found(F.col("t")).alias("f"), p.any(F.col("t")).alias("a")).collect()}
        for k, t in enumerate(texts):
            want = None if t is None else [j for j, w in enumerate(p.patterns) if w in t]
            assert got[k] == (want, None if t is None else bool(want))


def test_lexicon_equals_counting_each_keyword(spark):
    lexicon = {"g": ["tax", "irs", "tax"], "h": ["irs", "ab", "a"], "none": []}
    texts = some_texts()
    known = Lexicon(lexicon)
    rows = spark.createDataFrame([(k, t, ["g", "h", "none", "?", None][k % 5]) for k, t in enumerate(texts)], "k int, t string, v string")
    got = rows.select("k", known.hits(F.col("t")).alias("h"), known.hits_of(known.hits(F.col("t")), F.col("v")).alias("own"), curate.infer_vector(F.col("t"), known).alias("vector")).collect()
    for r in got:
        low = (texts[r.k] or "").lower()
        want = [sum(w in low for w in words) for words in lexicon.values()]
        assert r.h == want and r.own == dict(zip(lexicon, want, strict=True)).get(["g", "h", "none", "?", None][r.k % 5], 0)
        assert r.vector == ("phishing" if not max(want) else list(lexicon)[want.index(max(want))])


def test_lexicon_from_a_table(spark):
    rows = [("h", "irs", 3), ("g", "tax", 1), ("g", "irs", 2), (None, "x", 4), ("h", None, 5)]
    known = Lexicon.from_table(spark.createDataFrame(rows, "vector string, keyword string, position int"))
    assert known.keywords == {"g": ["tax", "irs"], "h": ["irs"]}
    with pytest.raises(ValueError, match="bytes of patterns"):
        Patterns(["x" * (5 << 20)])


@pytest.mark.parametrize("block", [1 << 20, 30])
def test_containing_equals_in(spark, block):
    rng = random.Random(3)
    words = ["the", "of", "tax", "été", "law", "won", "x"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(120)] + [None, "", "pretaxlaw", "﻿tax law"]
    passages = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 2, 2, 3, 4, 5, 5, 6, 7, 9) for _ in range(3)] + [" x the of ", "zz", None, " ", "taxl"]
    passages = [p for p in passages if p not in ("the", "of", "tax", "été", "law", "won", "x")]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = {r.digest for r in curate.containing(df, spark.createDataFrame([(p,) for p in passages], "text string"), block).collect()}
    held = {hashlib.sha256(t.encode()).hexdigest() for t in texts if t is not None and any(p.strip() and p.strip() in t for p in passages if p is not None)}
    assert got == held and 0 < len(held) < len(texts)


def test_containing_has_no_nested_loop(spark):
    df = spark.createDataFrame([("a tax law of the land won",)], "text string")
    plan = curate.containing(df, spark.createDataFrame([("tax",), ("tax law of the land",)], "text string"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
