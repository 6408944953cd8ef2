"""Rules behind plain search, and the rows of a task."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from conftest import SF
from sieveline.functions import scoring, text
from sieveline.operators.ordering import spread
from sieveline.plans import messages

RULES = {f"hit_{f}_{k}": r for f, (_, rules) in scoring.FAMILIES.items() for k, r in enumerate(rules)}


def some_texts(n=3000, seed=5):
    """Parts of the rules' own expressions and of other words, joined by all kinds of gaps."""
    rng = random.Random(seed)
    parts = [p.replace("\\", "").replace("?", rng.choice(["", "?"])) for r in RULES.values() for p in re.split(r"[|()]", r.regex) if p]
    parts += ["within 3 hours", "expires in 9", "fees", "fund", "$12", "12 dollars", "http://a", "https://b c", "!!!", "risk free", "riskXfree", "you won", "you've won", "mothers maiden", "mother's maiden", "failure to", "verify your account", "é", "_", "9", "100%", ""]
    return ["".join(rng.choice(parts) + rng.choice(["", " ", " ", "  ", "\t", "-", "é", ". "]) for _ in range(rng.randint(0, 6))).lower() for _ in range(n)]


def test_plain_search_loses_no_match(spark):
    texts = some_texts()
    rows = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "k int, t string")
    got = rows.select(*(c.alias(n) for n, c in scoring.rule_matches(F.col("t")).items())).collect()
    bare = {n: F.regexp_extract_all("t", F.lit(r.java), F.lit(0)) if r.every else F.regexp_extract("t", r.java, 0) for n, r in RULES.items()}
    want = rows.select(*(c.alias(n) for n, c in bare.items())).collect()
    assert all(r.needs for r in RULES.values()) and got == want
    assert [n for n in RULES if not any(w[n] for w in want) or all(w[n] for w in want)] == []


@pytest.mark.parametrize("compose", [True, False])
def test_texts_passed_through_are_normal(spark, compose):
    texts = ["a", "A b", " A  B ", "a\tb", "a\x0bb\n", "\ta", "a b", "pа y", "café X", "a​b", "﻿ a", "a　　b", "", " ", None, "ab\u0000c", "İ"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: r.n for r in rows.select("k", text.normalized(F.col("t"), compose).alias("n")).collect()}
    table = {ord(a): b for a, b in zip(text.LOOKALIKES, text.LATIN, strict=True)} | {ord(c): None for c in text.ZERO_WIDTH}
    for k, t in enumerate(texts):
        if t is None:
            assert got[k] is None
            continue
        low = unicodedata.normalize("NFC", t.lower()) if compose else t.lower()
        assert got[k] == re.sub(f"[{text.SCRIPT_SPACES}]+", " ", low.translate(table)).strip(text.SCRIPT_SPACES)


def test_types_equal_those_of_patterns(spark):
    m = messages.messages(spark, SF)
    types = scoring.detect_types({f: F.col(f"n_{f}") for f in messages.FAMILIES}, F.col("homoglyph"))
    patterns = scoring.detect_patterns(F.col("msg"), F.col("t"), messages.hits())
    got = m.limit(200).select(types.alias("types"), patterns.alias("patterns")).collect()
    assert all(r.types == [p.type for p in r.patterns] for r in got) and any(len(r.types) > 1 for r in got)


def test_tasks_have_bounded_rows(spark, tmp_path):
    """A table of many short rows in few splits is dealt by its rows, not by the number of cores alone."""
    spark.range(10_000).coalesce(1).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    out = spread(rows, 100)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 100 and max(sizes) <= 110 and sum(sizes) == 10_000
    assert spread(rows).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_tasks_of_one_row_group_have_bounded_rows(spark, tmp_path):
    """Many splits of a file with one row group: one has all rows, so their number says nothing."""
    spark.range(10_000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("wide")).coalesce(1).write.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = spark.read.parquet(str(tmp_path / "t")).select("id")
        assert rows.rdd.getNumPartitions() > 100 and max(rows.rdd.glom().map(len).collect()) == 10_000
        sizes = spread(rows, 100).rdd.glom().map(len).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert max(sizes) <= 110 and sum(sizes) == 10_000


def test_empty_tables_are_spread(spark, tmp_path):
    spark.range(0).write.parquet(str(tmp_path / "t"))
    assert spread(spark.read.parquet(str(tmp_path / "t")), 100).count() == 0


def test_families_by_batch_equal_those_by_rule(spark):
    texts = [*some_texts(seed=6), None, "urgent", "you won!! !!! !!!! !!!!!", "risk free", "http://a b http://c"]
    t = F.col("t")
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, t string")
    n, said = scoring.family_matches(t)
    alone = scoring.family_counts(t)
    columns = [c.alias(f"{x}_{f}") for x, by in (("n", n), ("said", said), ("alone", alone)) for f, c in by.items()]
    want = rows.select("k", *(F.struct(scoring.family_count(t, f).alias("n"), scoring.matched_text(t, f).alias("said")).alias(f) for f in messages.FAMILIES)).collect()
    got = rows.select("k", *columns).collect()
    for g, w, x in zip(got, want, texts, strict=True):
        for f in messages.FAMILIES:
            have = (g[f"n_{f}"], g[f"alone_{f}"], g[f"said_{f}"] or "")
            assert have == ((w[f].n, w[f].n, w[f].said) if x is not None else (0, 0, "")), (x, f)


def test_dot_is_any_but_line_ends(spark):
    """As in JavaScript: U+0085 ends no line."""
    rows = spark.createDataFrame([(k, f"risk{c}free") for k, c in enumerate("\x85-\n\r ")], "k int, t string")
    rule = RULES["hit_too_good_to_be_true_2"]
    found = rows.select("k", scoring.rule_match(F.col("t"), rule).alias("java"), scoring.rule_matches(F.col("t"))["hit_too_good_to_be_true_2"].alias("arrow")).orderBy("k").collect()
    assert [r.java for r in found] == [r.arrow for r in found] == ["risk\x85free", "risk-free", "free", "free", "free"]


@pytest.mark.parametrize("query", ["red_flags", "explanations", "heuristic_score", "matched_texts"])
def test_rules_run_by_batch(spark, query):
    """Java's expressions, which try each alternative at each place, run on no message."""
    plan = messages.QUERIES[query][0](spark, SF)._jdf.queryExecution().executedPlan().toString().lower()
    assert "regexp_extract" not in plan and "arrowevalpython" in plan


@pytest.mark.parametrize("query", ["explanations", "red_flags", "safety_tips", "fusion_max"])
def test_methods_are_small_enough_to_be_compiled(spark, query, capsys):
    """The JVM interprets a generated method of more than 8,000 bytes, at several times the cost."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        messages.QUERIES[query][0](spark, SF).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert len(sizes) > 2 and max(sizes) < 8000


def test_explanations_build_no_arrays(spark):
    plan = messages.explanations(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan and "array_contains" not in plan


def test_scores_by_batch_equal_those_of_columns(spark):
    """To the last bit, with and without matched texts; a null text has what its SQL gives."""
    texts = [*some_texts(2000, seed=7), "pа y now", "а", ""]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, raw string").select("k", text.normalized(F.col("raw")).alias("t"), text.has_homoglyphs(F.col("raw")).alias("h"))
    t, h = F.col("t"), F.col("h")
    want = rows.select("k", "h", *(c.alias(f) for f, c in scoring.family_counts(t).items())).select("k", scoring.heuristic_from_counts({f: F.col(f) for f in messages.FAMILIES}, h).alias("s"))
    want = {r.k: r.s for r in want.collect()}
    for said in (False, True):
        got = rows.select("k", *(c.alias(n) for n, c in scoring.family_scores(t, h, said).items())).collect()
        assert {r.k: r.heuristic for r in got} == want and len(set(want.values())) > 20
    null = spark.createDataFrame([(None, None)], "t string, h boolean").select(scoring.family_scores(t, h)["heuristic"].alias("s")).first()
    assert null.s == 1.0
