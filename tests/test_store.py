"""Documents that are changed, looked up and appended to in place."""

import os
import random

import pytest
from pyspark.sql import functions as F

from sieveline.operators import membership
from sieveline.sources import store


def files(at):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(at) for f in names if f.endswith(".parquet")}


def test_upsert_rewrites_touched_buckets_alone(spark, tmp_path):
    at = str(tmp_path / "docs")
    docs = spark.range(500).select(F.col("id").alias("user_id"), F.lit("none").alias("last"), F.lit(5).cast("long").alias("n"))
    store.write_documents(docs, at, "user_id", 16)
    before = files(at)
    updates = spark.createDataFrame([(3, 1, "view", 1), (3, 2, "click", 1), (9000, 1, "open", 2)], "user_id long, event_id long, last string, n long")
    merge = lambda d, u: membership.merged(d, u, "user_id", "event_id", ("last",), ("n",))
    n = store.upsert(spark, at, updates, "user_id", merge, 16)
    after = files(at)
    assert 1 <= n <= 2 and len([f for f in before if after.get(f) == before[f]]) == len(before) - n
    got = {r.user_id: (r["last"], r.n) for r in store.read_documents(spark, at).collect()}
    assert len(got) == 501 and got[3] == ("click", 7) and got[9000] == ("open", 2) and got[4] == ("none", 5)
    assert store.upsert(spark, at, updates.limit(0), "user_id", merge, 16) == 0 and files(at) == after


def test_lookup_opens_the_files_of_its_range(spark, tmp_path):
    at = str(tmp_path / "members")
    rows = [(k % 97, k) for k in range(2000)] + [(None, -1)]
    random.Random(1).shuffle(rows)
    store.write_sorted(spark.createDataFrame(rows, "family_id long, user_id long"), at, "family_id", 8)
    got = store.lookup(spark, at, "family_id", [3, 50])
    assert sorted(r.user_id for r in got.collect()) == sorted(u for f, u in rows if f in (3, 50))
    assert len(got.inputFiles()) <= 2 < len(files(f"{at}/rows"))
    for none in ([1000], [], [None]):
        assert store.lookup(spark, at, "family_id", none).count() == 0


def test_append_once(spark, tmp_path):
    at = str(tmp_path / "samples")
    assert store.read_appended(spark, at, "k long").count() == 0
    batch = lambda k: spark.range(10 * k, 10 * k + 10).select(F.col("id").alias("k"))
    assert store.append_once(batch(0), at, "b0") and store.append_once(batch(1), at, "b1")
    store.stage_batch(batch(2), at, "b2")  # a run that broke off here
    assert store.read_appended(spark, at, "k long").count() == 20
    assert [store.append_once(batch(k), at, f"b{k}") for k in range(4)] == [False, False, True, True]
    assert sorted(r.k for r in store.read_appended(spark, at, "k long").collect()) == list(range(40))
    with pytest.raises(ValueError, match="name"):
        store.append_once(batch(0), at, "../x")
