"""Operators 2, 8 and 9: learned parts by held-out accuracy, fixed parts against plain versions."""

import collections
import hashlib
import re

import numpy as np

from conftest import SF
from sieveline.llm import language_id, pii, quality


def test_language_query(spark):
    rows = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    import zlib

    got = language_id.op2_language_id(spark, SF).collect()
    assert len(got) == len(rows) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r.lang_pred == rows[r.doc_id] for r in got if r.held_out]
    assert np.mean(held) > 0.95


def calibration_error(score, right, bins=10):
    """Expected calibration error, over equal bins of the score."""
    at = np.minimum((score * bins).astype(int), bins - 1)
    return sum(abs(score[at == b].mean() - right[at == b].mean()) * (at == b).mean() for b in np.unique(at))


def test_scores_are_calibrated(spark):
    """On held-out whole texts, which all are told apart, and on held-out snippets, which aren't."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null")
    held = docs.where(language_id.held_out()).select("text", "lang").collect()
    model = language_id.train(docs.where(~language_id.held_out()))
    assert 0.01 < model.temperature < 20  # not at an end of the grid
    for cut in (lambda t: t, language_id.snippet):
        p = np.array([language_id._softmax(model.logits(*language_id.gram_counts(cut(r.text))).astype(float) / model.temperature) for r in held])
        right = np.array([model.languages[k] == r.lang for k, r in zip(p.argmax(1), held, strict=True)])
        assert calibration_error(p.max(1), right) < 0.08


def test_temperature_of_noisy_labels():
    rng = np.random.default_rng(4)
    logits = rng.normal(size=(4000, 3)) * 6
    y = np.array([rng.choice(3, p=p) for p in language_id._softmax(logits / 4)])
    assert 3.4 < language_id.fit_temperature(logits, y) < 4.6
    assert language_id.fit_temperature(logits[:0], y[:0]) == 1.0


def test_language_edges(spark):
    texts = ["the cat sat on the mat", "der hund und die katze", None, "", "123 !!", "the dog ran"]
    rows = [(k, texts[k % 6], ["en", "de", "en", "de", None, "en"][k % 6], 5, k) for k in range(120)] + [(None, "the end", "en", 1, -1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, p int")
    got = language_id.identify(df).collect()
    assert sorted(r.p for r in got) == [-1, *range(120)] and set(got[0].asDict()) == {*df.columns, "held_out", "lang_pred"}
    assert len(got) == 121 and all(r.lang_pred == ("und" if r.text in (None, "", "123 !!") else r.lang or "en") for r in got if r.doc_id is not None)
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    assert language_id.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.identify(df.withColumn("lang", language_id.F.lit(None).cast("string"))).collect()} == {"und"}


def test_grams_of_long_texts_are_whole():
    text = "abc déf " * 50_000
    whole = language_id.gram_counts(text)
    size, language_id._SLICE = language_id._SLICE, 1000
    try:
        cut = language_id.gram_counts(text)
    finally:
        language_id._SLICE = size
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True))


def plain_base(text):
    """The contract's patterns, as they stand."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[ -]", "", m.group())
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_base_spans_equal_the_patterns():
    import random

    rng = random.Random(5)
    parts = ["a", "B.c", "@", "x@y.z", "a@b", "@c.d", ".", "-", " ", "1", "255", "256", "1.2.3.4", "4111111111111111", "4111 1111-1111 1111", "+1 (988) 555-2485", "+", "é", "5", "0", "+49", "..", "%"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [(k, s, e) for _, k, s, e in pii.base_spans(text)] == plain_base(text), text


def test_pii_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = pii.op8_pii(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        base = plain_base(texts[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in base) for x in pii.KINDS[:4])
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(filter(None, r.spans.split(",")))


def test_pii_edges(spark):
    rows = [(1, "mail a.b@c.org now"), (1, "mail a.b@c.org now"), (2, None), (3, ""), (4, "é" * 50_000 + " 1.2.3.4"), (5, "write joe (at) mail (dot) com or (988) 555-2485"), (6, "clean text"), (7, "1" * 50_000), (8, "a" * 50_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, spans int")
    got = pii.find_personal_data(df).collect()
    assert [len(r.spans) for r in got if r.doc_id in (2, 3, 6, 7, 8)] == [0] * 5
    assert [x.start for r in got if r.doc_id == 4 for x in r.spans] == [50_001]
    assert [x.kind for r in got if r.doc_id == 5 for x in r.spans] == ["email", "phone"]
    assert pii.redact(df.where("doc_id = 1")).first()["text"] == "mail <EMAIL> now"
    assert pii.find_personal_data(df.limit(0)).count() == 0


def test_planted_spans(spark):
    """Written-out addresses, national numbers and keys are found; look-alikes in other contexts are not."""
    import random

    rng = random.Random(11)
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    name = lambda: "".join(rng.choice("abcdefghilmnoprst") for _ in range(rng.randint(3, 8)))
    phone = lambda: f"({rng.randint(200, 989)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    good = {
        "email": lambda: ("please write to ", f"{name()} (at) {name()} (dot) {rng.choice(['com', 'org', 'net'])}"),
        "phone": lambda: ("call my phone ", phone()),
        "secret": lambda: ("token = ", hexed(40)),
    }
    bad = {
        "email": lambda: ("we met in section ", f"{name()} (at) {name()}.{rng.randint(10, 99)}"),
        "card": lambda: ("order serial ", "".join(rng.choice("1789") for _ in range(13)) + "x"),
        "secret": lambda: ("section ", "-".join(["a"] * 12) + "1" * 12),
    }
    rows, want = [], {}
    for k in range(600):
        kind, wanted = (rng.choice(list(good)), True) if k % 2 else (rng.choice(list(bad)), False)
        before, span = (good if wanted else bad)[kind]()
        text = f"{name()} {name()} {before}{span} {name()}"
        rows.append((k, text))
        want[k] = [(kind, text.index(span), text.index(span) + len(span))] if wanted else []
    got = {r.doc_id: [(x.kind, x.start, x.end) for x in r.spans] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for kind in good:
        assert np.mean([got[k] == w for k, w in want.items() if w and w[0][0] == kind]) > 0.95, kind
    assert np.mean([not got[k] for k, w in want.items() if not w]) > 0.95


def test_span_features_see_more_than_votes():
    a, b = pii.span_features("= ", "a1" * 20, " x"), pii.span_features("= ", "1a2b3c4d5e6f7a8b9c0d", "")
    assert len(a) == len(b) == (1 << pii.SHAPE_BITS) + pii.NUMBERS and (a != b).any()
    assert np.isfinite(pii.span_features("", "é" * 30, "")).all() and np.isfinite(pii.span_features("", "", "")).all()


def test_reliabilities_find_the_good_labelers():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    votes = np.stack([np.where(rng.random(4000) < p, truth, ~truth) * 2 - 1 for p in (0.95, 0.9, 0.85, 0.6, 0.5)], 1)
    table, p = pii.reliabilities(votes, np.zeros(4000, int), np.ones(4000))
    assert ((p > 0.5) == truth).mean() > 0.95 and table[0, 1, 2] > 0.9 > 0.65 > table[4, 1, 2]


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    n = collections.Counter(windows)
    hit = {k + j for k, w in enumerate(windows) if n[w] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:k] for k, x in enumerate(lines)), len(hit)


def test_statistics():
    for text in (None, "", " \n", "a a a a", "a b c\na b c\n\n x", "é b c d # | <>", "a b c a b c a", "x"):
        assert quality.statistics(text)[0] == plain_counts(text), text


def test_quality_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = []
    for r in quality.op9_quality_rules(spark, SF).collect():
        if r.doc_id in texts:
            n = plain_counts(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
            assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r.base_failed and r.kept)
            if r.doc_id in labels and not r.base_failed:
                right.append(r.kept == bool(labels[r.doc_id]))
    assert np.mean(right) > 0.9


def test_quality_of_rows_that_did_not_train(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality is not null")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    other = {r.doc_id: r.quality for r in labels.where("doc_id % 3 = 0").collect()}
    got = quality.assess(docs, labels.where("doc_id % 3 <> 0")).where(~quality.F.col("base_failed")).collect()
    right = [r.kept == bool(other[r.doc_id]) for r in got if r.doc_id in other]
    assert len(right) > 50 and np.mean(right) > 0.85


def test_trees_are_monotonic_and_flat():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 0]) + 0.5 * x[:, 1] + 0.2 * rng.standard_normal(3000) > 0.8).astype(float)
    trees = quality.fit_trees(x, y, np.array([1, -1, 0]))
    grid = np.repeat(rng.random((50, 3)), 40, 0)
    for j, sign in ((0, 1), (1, -1)):
        g = grid.copy()
        g[:, j] = np.tile(np.linspace(0, 1, 40), 50)
        assert (np.diff(trees.score(g).reshape(50, 40), axis=1) * sign >= -1e-12).all()
    assert (((trees.score(x) > 0) == (y > 0)).mean()) > 0.75


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 1, 7), (2, "", 1, 7), (2, "w " * 100, 1, 7), (None, " ".join(map(str, range(100))), 1, 7)], "doc_id long, text string, kept int, s int")
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    got = quality.assess(docs, labels).collect()
    assert all(r.s == 7 for r in got)
    assert len(got) == 4 and sum(r.kept for r in got) <= 1 and all(r.base_failed for r in got if r.doc_id)
    assert quality.assess(docs.limit(0), labels.limit(0)).count() == 0


def test_many_rows_of_one_id_train_as_one(spark):
    """Five thousand rows share an id: one of them trains, whichever tasks see them, and none multiplies."""
    rng = np.random.default_rng(1)
    words = {"en": ["the", "cat", "of", "with"], "de": ["der", "und", "mit", "zu"]}
    rows = [(k, " ".join(rng.choice(words[y], 5)), y) for k in range(200) for y in [("en", "de")[k % 2]]] + [(7, f"der hund {k % 50}", "de") for k in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = [language_id.train(df.repartition(n), per_language=60) for n in (1, 7)]
    assert (models[0].weights == models[1].weights).all() and models[0].temperature == models[1].temperature
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, quality int")
    trees = [quality.train(df.repartition(n), labels) for n in (1, 7)]
    assert all((getattr(trees[0], f) == getattr(trees[1], f)).all() for f in ("feature", "threshold", "value"))


def test_ftrl_equals_a_plain_version():
    """Coordinate by coordinate, one example after the other."""
    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(12, 4, replace=False)), rng.random(4)) for _ in range(60)]
    y = rng.integers(0, 3, 60)
    alpha, beta, l1, l2 = 0.7, 1.1, 0.02, 0.01
    got, bias = language_id.fit_ftrl(rows, y, 3, 12, 2, alpha, beta, l1, l2)
    z, n = [[0.0] * 3 for _ in range(13)], [[0.0] * 3 for _ in range(13)]

    def weight(i, c):
        if abs(z[i][c]) <= l1:
            return 0.0
        return ((l1 if z[i][c] > 0 else -l1) - z[i][c]) / ((beta + n[i][c] ** 0.5) / alpha + l2)

    order = np.random.default_rng(0)
    for _ in range(2):
        for e in order.permutation(60):
            x = {**dict(zip(rows[e][0].tolist(), rows[e][1].tolist(), strict=True)), 12: 1.0}
            w = {(i, c): weight(i, c) for i in x for c in range(3)}
            score = np.array([sum(v * w[i, c] for i, v in x.items()) for c in range(3)])
            p = np.exp(score - score.max()) / np.exp(score - score.max()).sum()
            for i, v in x.items():
                for c in range(3):
                    g = v * (p[c] - (y[e] == c))
                    z[i][c] += g - ((n[i][c] + g * g) ** 0.5 - n[i][c] ** 0.5) / alpha * w[i, c]
                    n[i][c] += g * g
    want = np.array([[weight(i, c) for c in range(3)] for i in range(13)])
    assert np.allclose(got, want[:12], atol=1e-6) and np.allclose(bias, want[12], atol=1e-6)
