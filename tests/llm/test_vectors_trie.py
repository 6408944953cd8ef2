"""Operators 11, 12 and 13 against plain versions and SQL."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from compare import duck, rows
from conftest import SF
from sieveline.llm import prefix_trie, queries, top_k, vector_codes

NAN, INF = float("nan"), float("inf")
ODD = [None, [1.0, None, 2.0, 3.0], [NAN, 1.0, 1.0, 1.0], [1.0, 1.0, INF, 1.0]]


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_top_k", "op13_prefix_trie"])
def test_query_equals_sql(spark, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), duck(SF).sql(queries.oracle_sql()[name]).df()
    assert len(got) and sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def some_vectors(n=90, width=16, seed=3):
    rng = random.Random(seed)
    out = [(k, [rng.choice([0.0, rng.gauss(0, 1)]) for _ in range(width)], rng.choice([None, 1, 2])) for k in range(n)]
    out += [(200 + k, v if v is None else v * 4, 1) for k, v in enumerate(ODD)]  # not kept
    out += [(None, [0.5] * width, 2), (100, out[3][1], 1), (100, out[3][1], 1), (100, [0.25] * width, None)]  # null and repeated keys, equal rows
    return out


def kept(vectors, scale):
    fine = [(k, v, y) for k, v, y in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    return [(k, [math.floor(scale * x) for x in v], y) for k, v, y in fine]


def plain_codes(vectors, rounds=6, scale=4096, parts=8, codes=16):
    own = kept(vectors, scale)
    width = max(len(v) for _, v, _ in own)
    wide = -(-width // parts)
    own = [(k, v + [0] * (wide * parts - len(v)), y) for k, v, y in own]
    first = sorted(own, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:codes]
    books = [[r[1][p * wide : (p + 1) * wide] for r in first] for p in range(parts)]

    def nearest(v, p):
        d = [sum((a - b) ** 2 for a, b in zip(v[p * wide : (p + 1) * wide], e, strict=True)) for e in books[p]]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v, _ in own:
            for p in range(parts):
                groups[p, nearest(v, p)[0]].append(v[p * wide : (p + 1) * wide])
        for (p, e), members in groups.items():
            books[p][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    found = [(k, "".join(f"{nearest(v, p)[0]:02x}" for p in range(parts)), sum(nearest(v, p)[1] for p in range(parts)), y) for k, v, y in own]
    total = defaultdict(int)
    for _, _, e, y in found:
        total[y] += e
    return sorted(((k, c, e, total[y]) for k, c, e, y in found), key=str), hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize("width", [16, 13])
def test_codes_equal_a_plain_version(spark, width):
    vectors = some_vectors(width=width)
    df = spark.createDataFrame([(*r, "x") for r in vectors], "vec_id long, embedding array<double>, label int, code string").repartition(3)
    got, books = vector_codes.compress(df)
    want, sha = plain_codes(vectors)
    assert sorted(((r.key, r.code, r.error, r.label_error) for r in got.collect()), key=str) == want and vector_codes.digest(books) == sha


def test_codes_of_few_and_no_rows(spark):
    few = [(5, [1.0, 2.0], 1), (4, [1.0, 2.0, 3.0], None), (6, [], None)]
    got, books = vector_codes.compress(spark.createDataFrame(few, "vec_id long, embedding array<float>, label int"))
    want, sha = plain_codes(few)
    assert sorted(((r.key, r.code, r.error, r.label_error) for r in got.collect()), key=str) == want and vector_codes.digest(books) == sha and len(books[0]) == 3
    none = spark.createDataFrame([(200 + k, v) for k, v in enumerate(ODD)], "vec_id long, embedding array<float>")
    assert vector_codes.compress(none)[0].count() == 0 == vector_codes.compress(none.limit(0))[0].count()


def test_bounds_keep_the_nearest_and_spare_work():
    rng = np.random.default_rng(2)
    for width in (1, 3, 8, 64):
        centres = rng.integers(-20_000, 20_000, (16, width))
        entries = np.concatenate([centres[:14], centres[:2]])  # ties go to the lower index
        x = np.concatenate([centres[rng.integers(0, 16, 500)] + rng.integers(-900, 900, (500, width)), rng.integers(-3, 3, (20, width)), np.zeros((1, width), int)])
        best, distance, exact = vector_codes.Codebook(entries).nearest(x)
        all_ = ((x[:, None, :] - entries[None]) ** 2).sum(2)
        assert (best == all_.argmin(1)).all() and (distance == all_.min(1)).all()
        assert exact < all_.size / 2 or width == 1
    with pytest.raises(ValueError):
        vector_codes.Codebook(np.full((1, 2), 1 << 40)).nearest(np.zeros((1, 2), np.int64))


def plain_top(vectors, k=10, scale=1024):
    own, out = kept(vectors, scale), []
    for i, (q, v, _) in enumerate(own):
        if q is not None and q % 100 == 0:
            found = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), c is None, c or 0) for j, (c, w, _) in enumerate(own) if j != i))[:k]
            out += [(q, r + 1, None if none else c, -s) for r, (s, none, c) in enumerate(found)]
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 7, "query_rows": 2, "lane_bytes": 1, "unit_blocks": 2}])
def test_top_equals_a_plain_version(spark, sizes):
    vectors = some_vectors(130) + [(k, [1.0] * (k % 17), 1) for k in range(300, 420)]  # ties and shorter vectors
    df = spark.createDataFrame([(*r, 1, 2) for r in vectors], "vec_id long, embedding array<double>, label int, rank int, score int").repartition(3)
    got = top_k.top_k(df, **sizes)
    assert sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()), key=str) == plain_top(vectors)
    assert top_k.top_k(df.limit(0)).count() == 0 and top_k.top_k(df.where("vec_id = 100").limit(1)).count() == 0


def test_large_scores_are_exact_or_fail(spark):
    df = spark.createDataFrame([(0, [2.0**20, 1.0]), (1, [2.0**20, 3.0]), (2, [-(2.0**20), 0.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in top_k.top_k(df).orderBy("rank").collect()] == [(1, 2**60 + 3 * 2**20), (2, -(2**60))]
    with pytest.raises(Exception, match="64 bits"):
        top_k.top_k(df.withColumn("embedding", top_k.F.transform("embedding", lambda x: x * 64))).collect()


def plain_trie(turns):
    conv = defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            conv[c].append((t is not None, t or 0, role or "", text or ""))
    for c in conv:
        conv[c].sort(key=lambda r: (r[0], r[1]))
    again = {}
    for c, own in conv.items():
        h = zlib.crc32(str(c).encode()) % 9
        again[c] = tuple(r[2:] for r in conv.get(c - c % 5, [])[:h] + own[h:])
    nodes = defaultdict(list)
    for c in sorted(again):
        for d in range(len(again[c]) + 1):
            nodes[again[c][:d]].append(c)
    out = []
    for path, members in nodes.items():
        under = [p for p in nodes if p[: len(path)] == path]
        ends = ",".join(str(c) for c in members if len(again[c]) == len(path))
        out.append((
            members[0], len(path), nodes[path[:-1]][0] if path else None, len(members), sum(len(p) == len(path) + 1 for p in under), sum(all(q[: len(p)] != p or q == p for q in under) for p in under),
            sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in under if p), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def trie(spark, turns):
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, depth int").repartition(3)
    got = prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefix_trie.ordered_turns(df)))
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_trie_equals_a_plain_version(spark):
    rng = random.Random(5)
    turns = []
    for c in [*range(0, 40), *range(61, 64)]:  # 61 to 63 begin with a conversation that doesn't exist; some end up without turns
        n = rng.choice([1, 1, 2, 3, 5, 9, 12])
        turns += [(c, t if t else None, rng.choice(["user", None]), rng.choice(["a", "é", None])) for t in range(n)]
    turns += [(None, 1, "user", "no conversation")]
    turns += [(c, t, "user", "same") for c in (200, 205, 210, 215) for t in range(70)]  # copies over more than one row of turns
    turns += [(c, t, "user", "same") for c in (220, 225) for t in range(69)]  # one ends within another
    turns += [(230, t, "user", "same" if t < 69 else "other") for t in range(75)]
    turns += [(300, 4, "user", "twice")] * 2
    assert trie(spark, turns) == plain_trie(turns)


def test_trie_of_little(spark):
    assert trie(spark, [(None, 0, "user", "x")]) == []
    one = [(5, 0, "user", "x"), (5, 1, "assistant", "y")]
    assert trie(spark, one) == plain_trie(one)
    turnless = [(c, 0, "user", "x") for c in (11, 12, 13, 14)]
    assert trie(spark, turnless) == plain_trie(turnless)


def test_long_conversations_are_cut_over_tasks(spark, monkeypatch):
    """Tasks of a few turns each: a conversation goes on in the tasks after the one where it began."""
    monkeypatch.setattr(prefix_trie, "n_partitions", lambda *a: 13)
    turns = [(10, t, "user", f"t{t}") for t in range(400)] + [(c, t, "user", "x") for c in (15, 16) for t in range(3)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = prefix_trie.ordered_turns(df)
    assert sorted((r.conv_id, r.pos) for r in got.collect()) == sorted((c, t + 1) for c, t, _, _ in turns)
    placed = {r.pos: r.k1 for r in got.where("conv_id = 10").collect()}
    assert placed == {r.turn + 1: r.k for r in df.where("conv_id = 10").select("turn", prefix_trie.F.xxhash64("role", "text").alias("k")).collect()}


def test_id_digests_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS_A_ROW", 20)
    members = [(g, c) for g in (1, 2) for c in range(g, 900, 2)]
    got = {r.rep: r.ends_sha256 for r in prefix_trie.id_digests(spark.createDataFrame(members, "rep long, conv_id long").repartition(5)).collect()}
    assert got == {g: hashlib.sha256(",".join(str(c) for h, c in members if h == g).encode()).hexdigest() for g in (1, 2)}
