"""Operators 4, 6 and 7 against brute force."""

import hashlib
import random

import numpy as np
import pytest

from conftest import SF
from sieveline.llm import decontamination, jaccard_join, repeats
from sieveline.llm.components import components
from sieveline.llm.shingles import shingle_hashes, words


def vocabulary(seed):
    rng = random.Random(seed)
    return rng, ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]


def test_search_equals_all_windows(spark):
    rng, v = vocabulary(1)
    items = [(k, " ".join(rng.choice(v) for _ in range(n))) for k, n in enumerate([14, 20, 20, 35, 60, 7, 3, 1])]
    docs = []
    for i in range(300):
        w = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = "zz"
        docs.append((i, " ".join(rng.choice(v) for _ in range(rng.randint(0, 50))) + " " + " ".join(w) + " " + " ".join(rng.choice(v) for _ in range(rng.randint(0, 50)))))
    rows = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = wanted = 0
    for r in rows:
        got, d = {x.item_id: x.similarity for x in r.leaks}, words(r.text)
        for j, other in items:
            o = words(other)
            size = min(5, len(o))
            ho, hd = shingle_hashes(o, size), shingle_hashes(d, size)
            m = len(o) - size + 1
            whole = [decontamination.weighted_similarity(ho, hd)] if size <= len(d) < len(o) else []
            best = max([decontamination.weighted_similarity(ho, hd[s : s + m]) for s in range(len(d) - len(o) + 1)] + whole, default=0)
            wanted += best >= 0.8
            found += j in got and got[j] == pytest.approx(best)
            assert j not in got or best >= 0.8
    assert found >= 0.99 * wanted and wanted > 100


def test_search_finds_items_cut_short(spark):
    rng, v = vocabulary(6)
    items, docs, want = [], [], {}
    for k in range(200):
        item = [f"{rng.choice(v)}{k}" for _ in range(rng.choice([8, 12, 20, 40, 100]))]
        cut = rng.randint(1, max(1, len(item) // 6))
        w = item[:-cut] if rng.random() < 0.5 else item[cut:]
        items.append((k, " ".join(item)))
        docs.append((k, " ".join(w)))
        whole = decontamination.weighted_similarity(shingle_hashes(item), shingle_hashes(w))
        if whole >= 0.8:
            want[k] = [(k, 0, len(w), pytest.approx(whole))]
    got = {r.doc_id: [tuple(x) for x in r.leaks] for r in decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert sum(got[k] == x for k, x in want.items()) >= 0.99 * len(want) and len(want) > 100
    assert all(not x for k, x in got.items() if k not in want)
    item = " ".join(rng.choice(v) for _ in range(100))
    docs = spark.createDataFrame([(1, item.rsplit(" ", 5)[0]), (2, item.rsplit(" ", 60)[0])], "doc_id long, text string")
    got = decontamination.leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).orderBy("doc_id").collect()
    assert [len(r.leaks) for r in got] == [1, 0]


def test_repeated_phrases_weigh_as_in_the_similarity(spark):
    """Where what differs is how often one phrase repeats, fingerprints of plain sums would be far apart."""
    rng, v = vocabulary(12)
    plain, phrase = [rng.choice(v) for _ in range(90)], [rng.choice(v) for _ in range(1)]
    item, doc = plain + phrase * 14, plain + phrase * 4
    want = decontamination.weighted_similarity(shingle_hashes(item), shingle_hashes(doc))
    rows = decontamination.leaks(spark.createDataFrame([(1, " ".join(doc))], "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string"))
    assert want >= 0.8 and [tuple(x) for x in rows.first()["leaks"]] == [(7, 0, len(doc), pytest.approx(want))]
    h = np.array([5, 7, 5, 9, 7, 5, 1, 2, 3, 4], np.uint64)
    for m in (1, 3, 6, 10):
        starts = np.arange(len(h) - m + 1)
        plainly = [decontamination.fingerprints(decontamination.signs(decontamination.occurrences(h[s : s + m])).sum(0, keepdims=True))[0] for s in starts]
        assert (decontamination.window_prints(h, starts, m) == plainly).all()


def test_index_guarantees_the_radius():
    rng = np.random.default_rng(2)
    for k in range(50):
        h = shingle_hashes([f"w{k}_{j}" for j in range(20)])
        own = decontamination.fingerprints(decontamination.signs(h).sum(0, keepdims=True))
        index = set(decontamination.block_keys(20, own, decontamination.NEAR)[0].tolist())
        bits = np.unpackbits(own.view(np.uint8))
        bits[rng.choice(128, decontamination.RADIUS, replace=False)] ^= 1
        other = np.packbits(bits).view(np.uint16)[None, :]
        assert index & set(decontamination.block_keys(20, other)[0].tolist())
        assert not index & set(decontamination.block_keys(21, other)[0].tolist())


def test_leaks(spark):
    rng, v = vocabulary(2)
    item = " ".join(rng.choice(v) for _ in range(30))
    docs = spark.createDataFrame([(1, "x y " + item.upper() + " z", 0), (1, item, 0), (2, None, 0), (3, "", 0), (None, item, 0), (4, "clean " * 5000, 0)], "doc_id long, text string, leaks int")
    bench = spark.createDataFrame([(7, item), (7, item), (8, None), (None, item), (9, "")], "item_id long, text string")
    got = decontamination.leaks(docs, bench).collect()
    assert sorted((str(r.doc_id), [x.item_id for x in r.leaks]) for r in got) == [("1", [7]), ("1", [7]), ("2", []), ("3", []), ("4", []), ("None", [7])]
    assert sorted(r.doc_id for r in decontamination.clean(docs, bench).collect()) == [2, 3, 4]
    assert decontamination.clean(docs, bench.limit(0)).columns == docs.columns and decontamination.clean(docs, bench.limit(0)).count() == 6
    assert all(not r.leaks for r in decontamination.leaks(docs, bench.limit(0)).collect()) and decontamination.leaks(docs.limit(0), bench).count() == 0


def test_leak_query(spark):
    """Every window of every text against every item: what is found is similar, and what is similar is found."""
    bench = [(b.item_id, shingle_hashes(words(b.text)), len(words(b.text))) for b in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.op4_decontamination(spark, SF).collect()}
    want = {}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        h = shingle_hashes(words(d.text))
        for item, own, n in bench:
            m = min(n - 4, len(h))
            hit = np.concatenate(([0], np.cumsum(np.isin(h, own))))
            starts = np.flatnonzero(hit[m:] - hit[:-m] >= 0.8 * m) if m > 0 else []  # of less than that a window can't be similar
            best = max((decontamination.weighted_similarity(own, h[s : s + m]) for s in starts), default=0)
            if best >= 0.8:
                want[d.doc_id, item] = best
    assert want and got == pytest.approx(want)


def classes(rows, least=0.8):
    """class_id and n_links of each row, pair by pair."""
    sets = [set(shingle_hashes(words(t)).tolist()) for _, t in rows]
    top, links = list(range(len(rows))), [0] * len(rows)

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= least - 1e-9:
                links[i] += 1
                links[j] += 1
                top[find(i)] = find(j)
    ids = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[find(k)] = min(ids.get(find(k), i), i)
    return sorted((str(i), str(ids.get(find(k))), links[k]) for k, (i, _) in enumerate(rows))


def test_join_equals_all_pairs(spark):
    rng, v = vocabulary(3)
    rows = []
    for _ in range(12):
        base = [rng.choice(v) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(v)
            rows.append((len(rows), " ".join(w)))
    rows += [(None, rows[0][1]), (500, None), (501, ""), (502, " \n"), (503, rows[1][1]), (503, rows[1][1]), (None, "one two"), (600, "one two")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, n_links int")
    for block in (96, 3):  # the second deals groups over several blocks
        got = jaccard_join.near_duplicates(df, block_nodes=block).collect()
        assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == classes(rows)
    kept = jaccard_join.keep_one(df).collect()
    want = {c for i, c, _ in classes(rows) if i != "None"}
    assert sorted(str(r.doc_id) for r in kept if r.doc_id is not None) == sorted(want) and sum(r.doc_id is None for r in kept) == 2
    assert kept[0].asDict().keys() == set(df.columns)
    assert jaccard_join.near_duplicates(df.limit(0)).count() == 0 and jaccard_join.keep_one(df.limit(0)).count() == 0


def test_join_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = jaccard_join.op6_jaccard_join(spark, SF).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == classes(rows)


def test_texts_that_share_an_id_keep_their_own_class(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(3, a, 0), (5, a, 0), (5, b, 0), (5, b, 0), (7, b, 1), (1, "", 0), (1, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k int")
    assert sorted(map(tuple, jaccard_join.keep_one(df).collect()), key=str) == sorted([rows[0], rows[2], *rows[5:]], key=str)


def near_copies(n, seed=8, changes=(1, 3), length=300):
    """n different texts, each with a few words changed of the same one."""
    rng, v = vocabulary(seed)
    base, out = [rng.choice(v) for _ in range(length)], set()
    while len(out) < n:
        w = list(base)
        for _ in range(rng.randint(*changes)):
            w[rng.randrange(len(w))] = f"{rng.choice(v)}{len(out)}"
        out.add(" ".join(w))
    return sorted(out)


def test_tables_follow_the_size_of_a_group(spark, monkeypatch):
    counts = {}

    def count(df, what):
        out = written(df, what)
        counts[what] = counts.get(what, 0) + out.count()
        return out

    written, size = jaccard_join.written, {}
    monkeypatch.setattr(jaccard_join, "written", count)
    for n in (500, 1000, 2000):
        counts.clear()
        rows = list(enumerate(near_copies(n)))
        got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert len(got) == n and len({r.class_id for r in got}) < n / 100
        size[n] = dict(counts)
    for what in size[500]:
        assert size[2000][what] <= max(4.6 * size[500][what], 2000), (what, [size[n][what] for n in size])


def test_unlinked_texts_of_one_band_are_compared_in_blocks(spark):
    # Similarity of about 0.7: many share bands, few are linked, so that blocks decide.
    rows = list(enumerate(near_copies(150, 9, (1, 3), 50)))
    want = classes(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (1024, 5):
        got = jaccard_join.near_duplicates(df, block_nodes=block).collect()
        assert [(i, c) for i, c, _ in sorted((str(r.doc_id), str(r.class_id), 0) for r in got)] == [(i, c) for i, c, _ in want]
        links, all_links = sum(r.n_links for r in got), sum(n for _, _, n in want)
        assert 0.99 * all_links <= links <= all_links


def test_bands():
    bands, rows = jaccard_join.plan_bands(0.8)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= 128


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5, 5)]
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            top[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in top}


def test_components_of_a_long_chain(spark):
    ids = list(range(1500))
    random.Random(5).shuffle(ids)  # a smallest label passes such a chain hop by hop, in hundreds of rounds
    edges = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == dict.fromkeys(range(1500), 0)
    assert components(edges.limit(0)).count() == 0


def removed(rows):
    """n_bytes, n_removed, n_spans and the kept bytes' digest, window by window; a null doc_id is the largest."""
    first, big = {}, 2**63 - 1
    data = [(big if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], i), i)
    out = []
    for (i, b), (own, _) in zip(data, rows, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        out.append((str(own), len(b), int(gone.sum()), int((gone & ~np.roll(gone, 1)).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone[:-1]].tobytes()).hexdigest()))
    return sorted(out)


def test_repeats_equal_all_windows(spark):
    from pyspark.sql import functions as F

    rng, v = vocabulary(5)
    shared = [" ".join(rng.choice(v) for _ in range(rng.randint(8, 40))) for _ in range(6)]
    rows = [(k, " ".join(rng.choice([*shared, " ".join(rng.choice(v) for _ in range(20))]) for _ in range(rng.randint(0, 6)))) for k in range(80)]
    rows += [(90, None), (91, ""), (92, "a" * 49), (93, "a" * 50), (94, "a" * 400), (95, "ab" * 100), (96, "é" * 60), (97, "é" * 60), (98, shared[0]), (98, shared[0] + "tail of its own"), (None, shared[1]), (None, shared[1]), (99, "a" * 5000 + shared[2])]
    df = spark.createDataFrame([(*r, 3, "k") for r in rows], "doc_id long, text string, n_bytes int, k string")
    got = repeats.without_repeats(df).withColumn("s", F.sha2("kept", 256)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.s) for r in got) == removed(rows)
    assert repeats.without_repeats(df.limit(0)).count() == 0


def test_contexts_of_a_frequent_anchor_are_dealt_by_window(spark, monkeypatch):
    # One passage in nearly all texts, each time between other words, and some of these surroundings repeated.
    rng, v = vocabulary(7)
    passage = "the same licence line stands in all of these"
    around = [f"{rng.choice(v)}{k} {passage} {rng.choice(v)}{k % 9} and so on to the end" for k in range(120)]
    rows = [(k, f"{rng.choice(v)}{k // 2} " + around[k % 100] + f" {k}") for k in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = removed(rows)
    from pyspark.sql import functions as F

    seen, real = [], repeats.contexts
    monkeypatch.setattr(repeats, "contexts", lambda lots, frequent, bits: seen.append(len(frequent)) or real(lots, frequent, bits))
    for least in (20, 20_000):
        monkeypatch.setattr(repeats, "FREQUENT", least)
        got = repeats.without_repeats(df).withColumn("s", F.sha2("kept", 256)).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.s) for r in got) == want
    assert seen[0] > 0 == seen[1]


def test_packed_rows():
    rng = np.random.default_rng(3)
    doc, k, a, b = (rng.integers(-(2**62), 2**62, 500), rng.integers(-(2**62), 2**62, 500), rng.integers(0, 2**32, 500), rng.integers(0, 50, 500))
    at, data = repeats.pack_rows([doc, k], [a, b], 7)
    got = [tuple(x) for d in data for x in zip(*(c.tolist() for c in repeats.unpack_rows(d, 2, 2)), strict=True)]
    assert sorted(got) == sorted(zip(doc.tolist(), k.tolist(), a.tolist(), b.tolist())) and sorted(at) == list(range(7))
    assert repeats.pack_rows([doc[:0], k[:0]], [a[:0], b[:0]], 7) == ([], [])


def test_anchors_of_long_texts_are_whole():
    rng, v = vocabulary(6)
    data = " ".join(rng.choice(v) for _ in range(3000)).encode()
    whole = repeats.anchors(data)
    size, repeats._SLICE = repeats._SLICE, 1000
    try:
        cut = repeats.anchors(data)
    finally:
        repeats._SLICE = size
    of = lambda a: [p for p, s, e in zip(a[0].tolist(), a[2].tolist(), a[3].tolist(), strict=True) for _ in range(s, e + 1)]
    assert of(whole) == of(cut) and len(of(whole)) == len(data) - 49


def test_repeat_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = repeats.op7_repeats(spark, SF).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == removed(rows)
