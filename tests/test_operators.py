"""Hand-worked cases and properties of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import SF
from sieveline.functions import fusion, scoring, text, wordpiece
from sieveline.operators import activity, curate, evalmetrics, similar
from sieveline.plans import metrics
from sieveline.sources import files
from sieveline.streaming import activity as stream


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "message, score",
    [("hello!!", 0.50), ("urgent", 0.95), ("urgent!!", 1.0), ("lottery", 0.65), ("selected", 0.80), ("urgent lottery", (0.9 * 0.3 + 0.6 * 0.35) / 0.65 + 0.10), ("hello", 0.0), ("", 0.0)],
)
def test_heuristic(spark, message, score):
    assert one(spark, message, lambda c: scoring.heuristic_score(scoring.detect_patterns(c))) == pytest.approx(score)
    counts = {f: scoring.family_count(text.normalized(F.col("x")), f) for f in scoring.FAMILIES}
    assert one(spark, message, lambda c: scoring.heuristic_from_counts(counts, text.has_homoglyphs(c))) == pytest.approx(score)


def test_matched_text_keeps_unmatched_groups(spark):
    assert one(spark, "Urgent", lambda c: scoring.detect_patterns(c))[0]["matchedText"] == "urgent, urgent, "


@pytest.mark.parametrize("value, found", [("pаypal", True), ("привет", False), ("a​b", True), ("abc", False)])
def test_homoglyphs(spark, value, found):
    assert one(spark, value, text.has_homoglyphs) is found


def test_ascii_word_boundary(spark):
    assert one(spark, "éirs", lambda c: scoring.family_count(c, "impersonation")) == 2


@pytest.mark.parametrize("space, python, script", [*((chr(c), True, False) for c in (0x1C, 0x1D, 0x1E, 0x1F, 0x85)), ("\ufeff", False, True), (" ", True, True), ("\u3000", True, True), ("\u200b", False, False)])
def test_white_space_of_two_languages(spark, space, python, script):
    assert one(spark, f"{space}a", text.strip) == f"{space}a".strip() and (f"{space}a".strip() == "a") is python
    assert one(spark, f"a{space}b", text.tokens) == f"a{space}b".split()
    assert one(spark, f"{space}a", lambda c: text.strip(c, text.SCRIPT_SPACES)) == ("a" if script else f"{space}a")
    split = ["a", "b"] if script else [f"a{space}b"]
    assert one(spark, f"a{space}b", text.word_split) == split
    if space not in text.ZERO_WIDTH:
        assert one(spark, f"a{space}{space}b", text.normalized) == ("a b" if script else f"a{space}{space}b")
    first = spark.createDataFrame([(1, "a"), (2, f"{space}a")], "i long, t string")
    assert curate.dedup_keep_first(first, "t", "i").count() == (1 if python else 2)


def test_nfc_and_space(spark):
    assert one(spark, " É ​A ", lambda c: text.normalized(c, compose=True)) == "é a"
    assert one(spark, "  a  b ", text.n_tokens) == 2
    assert one(spark, "a\u0000–b \n c", text.ocr_normalized) == "a-b c"
    assert one(spark, "```json\n{}\n```", text.fence_stripped) == "{}"


def test_fusion(spark):
    row = lambda v, c, t, mode="max": spark.range(1).select(fusion.fuse(F.lit(v).cast("double"), F.lit(c).cast("double"), F.lit(t).cast("double"), mode).alias("r")).first()["r"]
    assert row(None, None, 0.65).asDict() == {"fused_score": 0.65, "is_scam": True, "risk_level": "high", "confidence": 0.75}
    assert row(0.4, 1.0, None).asDict() == pytest.approx({"fused_score": 0.4, "is_scam": False, "risk_level": "medium", "confidence": 0.7})
    assert row(0.4, 1.0, 0.65)["confidence"] == pytest.approx(0.875)
    assert row(0.4, 1.0, 0.65, "weighted")["fused_score"] == pytest.approx(0.55)
    assert row(None, None, 0.5).asDict() == {"fused_score": 0.5, "is_scam": False, "risk_level": "high", "confidence": 0.5}


def test_wordpiece(spark):
    v = {"un": 1, "##do": 2, "[UNK]": 9, "undone": 4, "##d": 5, "##on": 6}
    encode = wordpiece.Trie(v).encode
    assert encode("undo") == [1, 2] and encode("unx") == [1, 9] and encode("xxun") == [9] and encode("undone") == [4]
    assert encode("undon") == [1, 2, 9] and encode("undxon") == [1, 5, 9, 6] and encode("un😀do") == [1, 9, 2] and encode("") == []
    df = spark.createDataFrame([("a " * 128,), ("a",), ("",)], "t string")
    got = wordpiece.encode(df, "t", wordpiece.fallback_vocabulary()).collect()
    assert [r.token_count for r in got] == [128, 3, 2] and got[0].input_ids[-1] == 102 and sum(got[1].attention_mask) == 3
    assert all(len(r.input_ids) == len(r.attention_mask) == 128 for r in got)
    assert one(spark, "a\\b`c, d", lambda c: F.concat_ws(" ", text.word_split(c))) == "a \\ b ` c , d"


def test_js_distance(spark):
    df = spark.createDataFrame([("p", "a b"), ("q", "a c"), ("r", "a b")], "g string, t string")
    got = {(r.a, r.b): r.jsd for r in curate.js_matrix(df, "g", "t").collect()}
    assert got["p", "q"] == pytest.approx(math.sqrt(math.log(2) / 2)) and got["p", "r"] == pytest.approx(0, abs=1e-7) and got["p", "p"] == 0
    assert all(got[a, b] == got[b, a] for a, b in got)


def test_tfidf_cosine(spark):
    a, b = spark.createDataFrame([(1, "aa bb")], "i long, text string"), spark.createDataFrame([(2, "aa cc")], "j long, text string")
    assert similar.similar_pairs(a, b, "i", "j", "text", 0.0).first()["similarity"] == pytest.approx(0.201993092)


def test_dedup_and_keywords(spark):
    df = spark.createDataFrame([(1, "a b"), (2, " a b\t"), (3, "c")], "i long, t string")
    assert sorted(r.i for r in curate.dedup_keep_first(df, "t", "i").collect()) == [1, 3]
    assert [r.i for r in curate.duplicate_ordinals(df, "t", "i").collect()] == [2]
    lexicon = {"g": ["tax", "irs"], "h": ["irs", "won"]}
    rows = spark.createDataFrame([("scam", "g", "tax due"), ("scam", "g", "irs tax"), ("safe", "g", "hi"), ("scam", "z", "irs tax")], "l string, v string, t string")
    assert [r.k for r in rows.select(curate.keyword_consistent(F.col("l"), F.col("v"), F.col("t"), lexicon).alias("k")).collect()] == [False, True, True, False]
    assert one(spark, "irs", lambda c: curate.infer_vector(c, lexicon)) == "g" and one(spark, "x", lambda c: curate.infer_vector(c, lexicon)) == "phishing"


def test_split_is_a_partition(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 7)
    got = curate.stratified_split(df, "g", "id").groupBy("g").pivot("split", ["train", "val", "test"]).count().collect()
    assert all(abs(r.test - 0.1 * (r.train + r.val + r.test)) <= 1 for r in got) and sum(r.train + r.val + r.test for r in got) == 1000


def test_adaptive_filter_equals_the_sequential_rule(spark):
    rows = metrics.predicted(spark, SF).withColumn("said", (F.col("score") > 0.5).cast("int")).withColumn("c", F.greatest("score", 1 - F.col("score")))
    got = {r.doc_id: r.kept for r in curate.adaptive_filter(rows, "doc_id", "lang", "label", "said", "c", 0.6, every=10).collect()}
    threshold, n, out, want = {}, {}, {}, {}
    for k, r in enumerate(rows.orderBy("doc_id").collect(), 1):
        keep = r.said == r.label and r.c >= threshold.get(r.lang, 0.6)
        want[r.doc_id] = keep
        n[r.lang] = n.get(r.lang, 0) + 1
        out[r.lang] = out.get(r.lang, 0) + (not keep)
        if k % 10 == 0:
            for v in n:
                if v not in threshold and out[v] / n[v] > 0.40:
                    threshold[v] = 0.5
    assert got == want


def test_metrics(spark):
    rows = [(1, 0.9)] * 3 + [(0, 0.9)] + [(1, 0.1)] * 2 + [(0, 0.1)] * 4
    m = evalmetrics.with_prf(evalmetrics.confusion(spark.createDataFrame(rows, "y int, s double"), "y", "s")).first()
    assert (m.precision, m.recall, round(m.f1, 4)) == (0.75, 0.6, 0.6667)
    auc = evalmetrics.roc_auc(spark.createDataFrame([(1, 0.9), (1, 0.4), (0, 0.4), (0, 0.1)], "y int, s double"), "y", "s")
    assert auc.first()["auc"] == 0.875
    assert evalmetrics.reliability(spark.createDataFrame([(1, 1.0)], "y int, s double"), "y", "s").count() == 0
    assert evalmetrics.latency(spark.createDataFrame([(0, float(x)) for x in (1, 2, 3, 4)], "g int, v double"), "g", "v").first()["p95"] == pytest.approx(3.85)


def test_folds(spark):
    log = lambda kinds: spark.createDataFrame([(1, f"2024-01-01 00:{k // 60:02}:{k % 60:02}", k, x) for k, x in enumerate(kinds)], "user_id long, ts string, event_id long, kind string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    r = activity.fold(log(["scam", "scam", "decay", "safe", "scam"])).first()
    assert (r.recent, r.risk) == (2, 14)
    assert activity.fold(log(["scam"] * 21 + ["decay"])).first()["risk"] == 99
    assert activity.fold(log(["scam"] * 21 + ["decay", "scam"])).first()["risk"] == 100
    days = spark.createDataFrame([(1, "2024-01-01 10:00:00", 1, "open"), (1, "2024-01-02 00:05:00", 2, "safe"), (1, "2024-01-02 09:00:00", 3, "open"), (1, "2024-01-03 09:00:00", 4, "open")], "user_id long, ts string, event_id long, kind string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert activity.active_days(days).first()["active_days"] == 2


def test_stream_equals_batch(spark):
    got = {r.user_id: r for r in metrics.activity_stream(spark, SF).collect()}
    log = metrics._log(spark, SF)
    batch = activity.counters(log).join(activity.active_days(log), "user_id", "left").join(activity.fold(log), "user_id")
    for r in batch.collect():
        g = got[r.user_id]
        assert (g.total_scans, g.scams, g.reports, g.recent, g.risk, g.active_days) == (r.total_scans, r.scams, r.reports, r.recent, r.risk, r.active_days or 1)
    source = spark.readStream.schema(spark.read.parquet(f"{SF}/events.parquet").schema).parquet(f"{SF}/event[s].parquet")
    query = stream.windowed_counts(metrics.log_of(source)).writeStream.format("memory").queryName("windowed").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("windowed").groupBy().sum("n").first()[0] >= log.count()


def test_invite_codes(spark):
    codes = [r.c for r in spark.range(500).select(activity.invite_code(F.col("id")).alias("c")).collect()]
    assert len(set(codes)) == 500 and all(len(c) == 8 and not set(c) & set("IO01") for c in codes)


def test_files(spark, tmp_path):
    lines = tmp_path / "x.jsonl"
    lines.write_text('{"text":"a","label":"scam","vector":"phishing","source":"ftc"}\n\nnot json\n{"text":"b","label":"x","vector":"safe","source":"ftc"}\n')
    good, bad = files.read_validated(spark, str(lines))
    assert good.count() == 1 and sorted(r.reject_reason for r in bad.collect()) == ["invalid JSON", "label"]
    assert files.read_lenient(spark, str(lines)).count() == 2 and files.bad_lines(spark, str(lines)).first()["line"] == "not json"
    with pytest.raises(Exception):
        files.read_strict(spark, str(lines)).collect()
    table = tmp_path / "u.csv"
    table.write_text("id,URL\n1, http://a \n2,\n")
    assert [r.url for r in files.read_urls(spark, str(table)).collect()] == ["http://a"]
    out = str(tmp_path / "out")
    files.write_locked(good, out)
    with pytest.raises(Exception):
        files.write_locked(good, out)
    files.write_report(good, str(tmp_path / "report"))
    v = tmp_path / "vocab.txt"
    v.write_text("[PAD]\n\n a \nb")
    assert wordpiece.read_vocabulary(spark, str(v)) == {"[PAD]": 0, "a": 2, "b": 3}
    blocks = spark.createDataFrame([([{"text": "t", "frame": {"left": 1, "top": 2, "width": 3, "height": 4}}],)], "b array<struct<text:string,frame:struct<left:int,top:int,width:int,height:int>>>")
    assert tuple(blocks.select(*files.text_regions("b")).first()) == ("t", 1, 2, 3, 4)
