"""Membership documents, sources and smaller operators without a query of their own."""

import pytest
from pyspark.sql import functions as F

from sieveline.functions import scorer, text, wordpiece
from sieveline.operators import activity, curate, evalmetrics, holdout, membership, ordering, similar
from sieveline.sources import files


def test_codes_are_unique_whatever_collides(spark):
    """Few possible codes: each key takes its first that neither the taken ones nor smaller keys of an earlier or the same round have."""
    code = lambda key, attempt: F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{attempt}"))), 1, 2)
    taken = spark.createDataFrame([("00",), ("7f",)], "invite_code string")
    got = membership.with_unique_codes(spark.range(60).withColumnRenamed("id", "k"), "k", taken, code).collect()
    assert len({r.invite_code for r in got}) == len({r.k for r in got}) == 60 and not {r.invite_code for r in got} & {"00", "7f"}
    with pytest.raises(RuntimeError):
        membership.with_unique_codes(spark.range(3).withColumnRenamed("id", "k"), "k", taken, lambda key, attempt: F.lit("00"), 3)


def test_merge_without_upsert(spark):
    docs = spark.createDataFrame([(1, "a", 2, ["x"]), (2, None, None, None)], "k long, s string, n long, t array<string>")
    updates = spark.createDataFrame([(1, 1, "b", 1, None, ["x"]), (1, 2, None, 1, ["y"], None), (2, 1, "c", 5, ["z"], None), (9, 1, "c", 1, None, None)], "k long, o long, s string, n long, union_t array<string>, remove_t array<string>")
    got = membership.merged(docs, updates, "k", "o", ("s",), ("n",), ("t",), ("t",), upsert=False)
    assert sorted(map(tuple, got.collect())) == [(1, "b", 4, ["y"]), (2, "c", 5, ["z"])]
    assert [r.k for r in membership.unmatched(docs, updates, "k").collect()] == [9]


def test_titles(spark):
    rows = spark.createDataFrame([("n", "m"), ("", "m"), (None, ""), (None, None)], "n string, m string")
    assert [r.t for r in rows.select(membership.member_title(F.col("n"), F.col("m")).alias("t")).collect()] == ["n", "m", "Member Profile", "Member Profile"]


def test_concatenation_keeps_clashing_columns(spark):
    a, b = spark.createDataFrame([(1, 5)], "x int, source_ordinal int"), spark.createDataFrame([(2, "q")], "x int, y string")
    got = sorted(map(tuple, membership.concatenated(a, b).select("x", "source_ordinal", "source_ordinal_", "y").collect()))
    assert got == [(1, 5, 0, None), (2, None, 1, "q")]


def test_scorers(spark):
    df = spark.createDataFrame([(1, "abcd"), (2, None)], "k int, t string")
    assert [r.s for r in scorer.batch_scorer(lambda ts: [len(t) / 2 for t in ts])(df, "t", "s").orderBy("k").collect()] == [1.0, 0.0]
    known = spark.createDataFrame([(1, 0.25)], "k int, p double")
    assert [r.s for r in scorer.table_scorer(known, "k", "p")(df, "t", "s").orderBy("k").collect()] == [0.25, None]
    assert spark.range(1).select(scorer.percent(F.lit(0.1234)).alias("p")).first()["p"] == "12.3%"


def test_rows_beside_each_other(spark):
    a, b = spark.range(5).withColumnRenamed("id", "a"), spark.range(10, 17).withColumnRenamed("id", "b")
    assert [(r.a, r.b) for r in ordering.beside(a, "a", b, "b").orderBy("a").collect()] == [(k, 10 + k) for k in range(5)]
    with pytest.raises(Exception, match="fewer rows"):
        ordering.beside(b, "b", a, "a").collect()


def test_ranges_of_any_size(spark):
    """Running totals in one range, in some and in so many that cuts are found in two steps."""
    df = spark.range(3000).select((F.col("id") * F.col("id") % 100_003).alias("o"), (F.col("id") % 7).alias("v"), (F.col("id") % 3).alias("g")).dropDuplicates(["o"])
    rows = sorted((r.o, r.v, r.g) for r in df.collect())
    want, total = {}, 0
    for o, v, _ in rows:
        want[o] = total
        total += v
    for size in (10_000, 500, 4):
        assert {r.o: r.t for r in ordering.running_total(df, "o", F.col("v"), "t", rows=size).collect()} == want
    place, seen = {}, {}
    for o, _, g in rows:
        seen[g] = seen.get(g, 0) + 1
        place[o] = seen[g]
    for size in (10_000, 100):
        assert {r.o: r.n for r in ordering.numbered(df, "o", "n", ("g",), size).collect()} == place
        assert ordering.numbered(df.limit(0), "o", "n", ("g",), size).count() == 0


def test_splits_in_ranges(spark):
    df = spark.range(2000).withColumn("g", F.when(F.col("id") % 5 > 0, F.col("id") % 2))
    one, many = (sorted(map(tuple, curate.stratified_split(df, "g", "id", rows=n).collect()), key=str) for n in (10_000, 50))
    assert one == many and len(one) == 2000
    assert sorted(map(tuple, curate.duplicate_ordinals(df.select("id", F.lit("x").alias("t")), "t", "id", 100).collect())) == [(k, k + 1) for k in range(1, 2000)]


def test_percentiles(spark):
    df = spark.createDataFrame([(g, float(k * k % 97)) for g in (1, 2) for k in range(g * 37)] + [(1, None)], "g int, v double")
    for r in evalmetrics.percentiles(df, "g", "v", {"a": 0.0, "b": 0.3, "c": 0.95, "d": 1.0}).collect():
        v = df.where(F.col("g") == r.g)
        want = v.agg(*(F.percentile("v", p) for p in (0.0, 0.3, 0.95, 1.0))).first()
        assert tuple(r)[1:] == pytest.approx(tuple(want))


def test_contained_passages(spark):
    docs = spark.createDataFrame([(1, "say one two three four five now"), (2, "xone two three four fivex"), (3, "one two three four"), (4, "a short bit"), (5, None), (6, "one  two three four five")], "i int, text string")
    passages = spark.createDataFrame([(" one two three four five ",), ("hort b",), ("",), (None,)], "text string")
    assert sorted(r.i for r in curate.decontaminate(docs, passages, mode="contains").collect()) == [3, 5, 6]
    assert curate.decontaminate(docs, passages.limit(0), mode="contains").count() == 6


def test_similarity_counts(spark):
    pairs = spark.createDataFrame([(0.5,), (0.85,), (0.9,), (0.99,)], "similarity double")
    assert [tuple(r) for r in similar.similarity_counts(pairs, 0.85, 0.95).collect()] == [(0.85, 2), (0.95, 1)]


def test_source_gates(spark):
    rows = lambda *s: spark.createDataFrame([(x, "safe") for x in s], "source string, label string")
    gate = lambda df: holdout.source_gates(df, rows=(1, 9), least_safe=1).first()
    assert (g := gate(rows("huggingface_difraud"))).automated_only and not g.passed and g.families == "automated"
    assert (g := gate(rows("ftc", "manual", "huggingface_difraud"))).passed and g.families == "automated,public,community"
    assert not gate(rows("ftc").limit(0)).passed and not (g := gate(rows("elsewhere"))).passed and not g.automated_only


def test_small_rules(spark):
    assert curate.consistency_threshold(0.5) == ("keyword", None) and curate.consistency_threshold(0.8) == ("model", 0.5) and curate.consistency_threshold(0.9) == ("model", 0.6)
    rows = spark.createDataFrame([("safe", "x"), ("scam", "y"), ("scam", None)], "l string, v string")
    assert [r.c for r in rows.select(curate.effective_class(F.col("l"), F.col("v")).alias("c")).collect()] == ["safe", "y", "unknown"]
    ids = spark.createDataFrame([([101, 104, 7],)], "i array<int>")
    assert ids.select(wordpiece.decode(F.col("i"), wordpiece.fallback_vocabulary()).alias("t")).first()["t"] == ["[CLS]", "a", "[UNK]"]
    said = spark.createDataFrame([("```json\n{\"a\": 3}\n```",), ("{",)], "s string")
    assert [r.v and r.v.a for r in said.select(text.fenced_json(F.col("s"), "a int").alias("v")).collect()] in ([3, None], [3, 0])
    assert holdout.split_of(rows.withColumn("split", F.lit("a"))).count() == 3 and holdout.split_of(rows.withColumn("split", F.lit("a")), "b").count() == 0
    assert activity.quota_plan(spark.createDataFrame([("safe", 101, 0)], "vector string, target int, existing int")).first()["hard"] == 25


def test_sources_and_sinks(spark, tmp_path):
    lines = tmp_path / "a.jsonl"
    lines.write_text("\n".join(['{"text":"a"}', "", "not json", '{"text":"b"}', "[1"]))
    assert [(r.number, r.line) for r in files.bad_lines(spark, str(lines)).orderBy("number").collect()] == [(3, "not json"), (5, "[1")]
    with pytest.raises(ValueError, match="line 3"):
        files.read_strict(spark, str(lines))
    rows = spark.createDataFrame([("a", 1), ("b", 0)], "sms string, label int")
    assert sorted(map(tuple, files.read_sms(rows).collect())) == [("a", "spam"), ("b", "ham")]
    at = str(tmp_path / "lines")
    files.write_lines(files.read_sms(rows), at)
    files.append_lines(files.read_sms(rows), at)
    assert files.read_strict(spark, at).count() == 4
    files.write_lines(files.read_sms(rows), at)
    assert files.read_strict(spark, at).count() == 2
    report = str(tmp_path / "report")
    files.write_report(spark.range(10_001), report)
    assert spark.read.json(f"{report}/rows").count() == 10_001 and spark.read.json(f"{report}/summary").first()["n_rows"] == 10_001
    soft = str(tmp_path / "soft")
    files.write_soft_labels(evalmetrics.soft_labels(spark.createDataFrame([(1, 0.0, 0.0)], "k int, z0 double, z1 double"), "k", "z0", "z1"), soft)
    assert spark.read.parquet(soft).where("t = 3.0").first()["p_scam"] == 0.5
    targets = spark.createDataFrame([("a", 3), ("b", 1)], "vector string, target int")
    have = spark.createDataFrame([("a",), ("b",), ("b",)], "vector string")
    assert sorted((r.vector, r.existing, r.remaining) for r in files.resume_counts(have, targets).collect()) == [("a", 1, 2), ("b", 2, 0)]
    documents = spark.createDataFrame([(1, "x")], "k int, s string")
    got = files.document_or_default(spark.createDataFrame([(1,), (2,)], "k int"), documents, "k", {"s": "none"})
    assert sorted(map(tuple, got.collect())) == [(1, "x"), (2, "none")]
