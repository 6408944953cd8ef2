"""Folds by parts, and the stream with daily decay, against sequential versions."""

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from sieveline.operators import activity, evalmetrics
from sieveline.plans.metrics import finished
from sieveline.streaming import decay

START = datetime(2024, 1, 1)


def some_log(n=600, users=7, days=30, seed=2, kinds=("scam", "safe", "open", "report")):
    rng = random.Random(seed)
    return [(rng.choice([0, 0, 0, *range(users)]), START + timedelta(days=rng.randrange(days), seconds=rng.choice([0, 0, 5, 86_399])), k, rng.choice(kinds)) for k in range(n)]


def frame(spark, log):
    return spark.createDataFrame(log, "user_id long, ts timestamp_ntz, event_id long, kind string")


def plain_fold(log):
    out = {}
    for u, _, _, kind in sorted(log, key=lambda r: (r[1], r[2])):
        recent, risk = out.get(u, (0, 0))
        out[u] = (recent + 1, min(100, risk + 5)) if kind == "scam" else (recent * 9 // 10, max(0, risk - 1)) if kind == "decay" else (recent, risk)
    return out


def test_fold_equals_the_sequential_one(spark):
    log = some_log(kinds=("scam", "scam", "decay", "decay", "safe"))
    for rows, decays in ((250_000, 1024), (50, 4)):
        got = {r.user_id: (r.recent, r.risk) for r in activity.fold(frame(spark, log), rows, decays).collect()}
        assert got == plain_fold(log)
    assert activity.fold(frame(spark, log[:0])).count() == 0


def test_composed_maps(spark):
    rng = random.Random(1)
    maps = [(rng.randint(-30, 30), *sorted((rng.randint(-20, 120), rng.randint(-20, 120)))) for _ in range(60)]
    col = lambda m: F.struct(*(F.lit(v).cast("long").alias(n) for v, n in zip(m, ("a", "lo", "hi"), strict=True)))
    pairs = list(zip(maps, maps[1:], strict=False))
    got = spark.range(1).select(*(activity.compose(col(f), col(g)).alias(str(k)) for k, (f, g) in enumerate(pairs))).first()
    run = lambda m, x: min(m[2], max(m[1], x + m[0]))
    for k, (f, g) in enumerate(pairs):
        assert all(run(tuple(got[str(k)]), x) == run(g, run(f, x)) for x in range(-50, 150, 7))


def test_a_hot_user_is_counted_before_any_shuffle(spark):
    """A million events of one user: no task gets more than a row for each of its days and each task before."""
    n = 1_000_000
    log = spark.range(n).select(F.lit(1).cast("long").alias("user_id"), (F.lit(START).cast("timestamp_ntz") + F.make_interval(secs=(F.col("id") % 864_000).cast("double"))).alias("ts"), F.col("id").alias("event_id"), F.when(F.col("id") % 3 == 1, "scam").otherwise("open").alias("kind"))
    got = activity.active_days(log).collect()
    assert [tuple(r) for r in got] == [(1, 10)]
    folded = activity.fold(activity.with_decay(log), rows=100_000).first()
    recent = 0
    for day in range(10):
        hits = sum(k % 3 == 1 for whole in (0, 864_000) for k in range(whole + 86_400 * day, min(n, whole + 86_400 * (day + 1))))
        recent = recent * 9 // 10 + hits
    assert folded.recent == recent and folded.risk == 100


def test_running_means_by_ordinal(spark):
    rows = [(e, 7 * k + 3, float(k % 5), float(k)) for e, n in ((0, 120), (1, 49)) for k in range(n)]
    df = spark.createDataFrame(rows, "epoch long, batch long, a double, b double")
    for size in (250_000, 30):
        got = {(r.epoch, r.kind, r.batch): (round(r.a, 9), round(r.b, 9)) for r in evalmetrics.running_means(df, "epoch", "batch", ("a", "b"), rows=size).collect()}
        mean = lambda e, n: tuple(round(sum(r[c] for r in rows if r[0] == e and r[1] < 7 * n + 3) / n, 9) for c in (2, 3))
        assert got == {(0, "log", 50): mean(0, 50), (0, "log", 100): mean(0, 100), (0, "epoch", 120): mean(0, 120), (1, "epoch", 49): mean(1, 49)}


def test_reliability_edges(spark):
    scores = [0.0, 0.1, 0.3, 0.6, 0.7, 0.30000000000000004, 0.9999, 1.0]
    got = {r.bin: r.n for r in evalmetrics.reliability(spark.createDataFrame([(1, s) for s in scores], "y int, s double"), "y", "s").collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 1, 5: 1, 6: 1, 9: 1}


def test_stream_with_decay_equals_the_batch_fold(spark, tmp_path):
    """Several files, each a run from where the last one stopped: late days count, timers decay what has no events."""
    decay.use_timers(spark)
    log = sorted(some_log(500, 6, 40, 9), key=lambda r: (r[1], r[2]))
    log = [r for r in log if r[0] != 5 or r[1] < START + timedelta(days=3)]  # a user who stops early
    cuts = [0, 90, 91, 300, len(log)]
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    for a, b in zip(cuts, cuts[1:], strict=False):
        frame(spark, log[a:b]).coalesce(1).write.mode("append").parquet(source)
        rows = spark.readStream.schema("user_id long, ts timestamp_ntz, event_id long, kind string").parquet(source)
        got = finished(decay.decaying_activity(rows, "1 second"), "user_id", state)
    through = (max(r[1] for r in log) - timedelta(seconds=1)).date()
    batch = activity.fold(activity.with_decay(frame(spark, log), F.lit(through)))
    want = {r.user_id: (r.recent, r.risk) for r in batch.collect()}
    days = {r.user_id: r.active_days for r in activity.active_days(frame(spark, log)).collect()}
    rows = {r.user_id: r for r in got.collect()}
    assert {u: (r.recent, r.risk) for u, r in rows.items()} == want
    assert {u: r.active_days for u, r in rows.items() if u in days} == days
    assert {u: r.scams for u, r in rows.items()} == {u: sum(x[0] == u and x[3] == "scam" for x in log) for u in want}


def test_late_days_are_counted():
    own = decay.Activity(None)
    own.add_day(date(2024, 1, 5), {"scam": 2}, "scam")
    own.decay_to(date(2024, 1, 7))
    assert (own.recent, own.risk) == (0, 8) and own.late == 0
    own.add_day(date(2024, 1, 5), {"scam": 1, "open": 1}, "open")
    assert (own.recent, own.risk, own.late, own.days, own.last) == (1, 13, 2, 1, date(2024, 1, 5))
