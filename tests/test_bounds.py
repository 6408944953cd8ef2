"""What a worker holds at a time, whatever a batch holds."""

import random
import time
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from sieveline import plans
from sieveline.functions import text, wordpiece
from sieveline.operators import similar


def test_term_counts_leave_in_small_batches():
    texts = ["w1 w2 w1"] * 5000 + [None, "", "x" * (similar.SLICE_CHARS + 1)] + ["a b"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["i", "words"])
    out = list(similar._counted_slices(iter([batch])))
    assert max(len(set(b.column(0).to_pylist())) for b in out) <= similar.SLICE_ROWS
    rows = [r for b in out for r in b.to_pylist()]
    assert len(rows) == 5000 * 4 + 1 + 3 * 3 and {(r["term"], r["tf"]) for r in rows if r["i"] == 4999} == {("w1", 2), ("w2", 1), ("w1 w2", 1), ("w2 w1", 1)}
    assert {r["term"] for r in rows if r["i"] == 5002} == {"x" * (similar.SLICE_CHARS + 1)} and not [r for r in rows if r["i"] in (5000, 5001)]
    assert [len(s) for s in similar.slices(pa.array(["ab", "c", None, "defg", "h"]), rows=3, chars=3)] == [3, 1, 1]


def test_words_by_one_class(spark):
    """Long words don't go through the regex engine a character a step; what is split is as before."""
    marks = ".,!?;:'\"()[]{}<>@#$%^&*+=-_/\\|`~"
    long = "ab😀é" * 50_000
    got = spark.createDataFrame([(f"{long} a{marks}b\u0085c d ﻿e\nf&&g",)], "t string").select(text.word_split(F.col("t")).alias("w")).first().w
    assert got == [long, "a", *marks, "b\u0085c", "d", "e", "f", "&", "&", "g"]


def test_only_words_that_can_stay_are_encoded(spark):
    v = wordpiece.fallback_vocabulary()
    for n in (125, 126, 127, 128, 400):
        r = wordpiece.encode(spark.createDataFrame([("a " * n,)], "t string"), "t", v).first()
        ids = [101, *[v["a"]] * n, 102]
        ids = ids if len(ids) <= 128 else [*ids[:127], 102]
        assert r.input_ids == ids + [0] * (128 - len(ids)) and r.token_count == len(ids)


def test_words_within_batches_are_those_of_columns(spark):
    """In parts of any size, with a memory of any size; also where composing makes or takes away marks, and look-alikes or spaces change."""
    draw = random.Random(7)
    odd = [*"ab aé.=<'-_\\[]^~\n\t\x1c\x85İΣσςаеТν", *text.ZERO_WIDTH, *text.SCRIPT_SPACES, "\u0301", "\u0338", "\u037e", "\u1fef", "\u212a", "\u2260", "\u1112", "\u1161", "😀", "ß"]
    rows = [(k, "".join(draw.choices(odd, k=draw.randrange(40)))) for k in range(2000)] + [(2000, None), (2001, ""), (2002, " "), (2003, "a" * 5000)]
    df = spark.createDataFrame(rows, "i long, t string")
    got = df.select(F.lower("t").alias("low"), text.word_split(text.normalized(F.col("t"))).alias("words")).collect()
    for chars in (1, 7, 100):
        assert all([w for part in text.words_by_part(r.low or "", chars) for w in part] == (r.words or []) for r in got)
    want = {w for r in got for w in r.words or []}
    assert {r.w for r in text.distinct_words(df, "t").collect()} == want
    batches = [pa.RecordBatch.from_arrays([pa.array([r.low for r in got[k : k + 50]], pa.string())], ["t"]) for k in range(0, len(got), 50)]
    for most in (1, 100, 1 << 18):
        assert {w for b in text._distinct_words(iter(batches), most) for w in b.column(0).to_pylist()} == want
    count = Counter()
    for b in wordpiece._count_pieces(iter([pa.RecordBatch.from_arrays([pa.array([w])], ["w"]) for w in ("abcdab", "abab", "a", "😀é")]), 3):
        count.update({r["token"]: r["n"] for r in b.to_pylist()})
    assert count == {"abc": 1, "##dab": 1, "aba": 1, "a": 3, "##a": 2, "##b": 2, "##c": 1, "##d": 1, "😀é": 1, "😀": 1, "##é": 1}


def test_texts_are_split_once(spark, tmp_path):
    """Exploding words made Spark split every text three times over, and each piece of a long word was looked for from the word's start."""
    long = "abcdé" * 60_000
    docs = [(k, f"w{k} abc{k} {'x' * k}") for k in range(20)] + [(20, f"{long} {long}z end"), (21, None)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    began = time.time()
    got = {r.doc_id: r for r in plans.queries()["wordpiece_documents"](spark, str(tmp_path)).collect()}
    assert time.time() - began < 60
    assert len(got) == 22 and got[21].token_count == 2 and got[20].token_count == 128 and got[20].ids.startswith("101,") and got[20].ids.endswith(",102")
    texts = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert "regexp" not in text.distinct_words(texts, "text")._jdf.queryExecution().executedPlan().toString()
