"""Operator 5 by an exact round trip, and the pipeline by what each stage keeps."""

import base64
import hashlib

from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF
from sieveline.llm import warc
from sieveline.llm.shingles import shingle_hashes, words


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_query(spark):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    best = {}
    for i, b in pages.items():
        best[b] = max(best.get(b, i), i)
    got = warc.op5_warc(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        b = pages[r.page_id]
        own = best[b] == r.page_id
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(b), digest(b), "response" if own else "revisit", None if own else best[b])


def test_queries_equal_sql(spark):
    from compare import duck, rows
    from sieveline.llm import queries

    for name, sql in queries.oracle_sql().items():
        assert rows(queries.queries()[name](spark, SF).toPandas()) == rows(duck(SF).sql(sql).df()), name


def test_whole_run(spark, monkeypatch):
    """run() against the stages one by one, each on a table of what its predecessor kept."""
    found = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "start", "length", "sequence_id", "offset", "ids_crc32", "doc_tokens"} <= set(found.columns)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.collect()}
    pieces = found.collect()
    total = {}
    for p in pieces:
        assert p.doc_tokens == want[p.doc_id]
        total[p.doc_id] = total.get(p.doc_id, 0) + p.length
    assert total == want and len({(p.sequence_id, p.offset) for p in pieces}) == len(pieces)


def test_edges(spark, tmp_path):
    rows = [(1, "u", "x\r\n\r\nWARC/1.1\r\n"), (2, "u", None), (3, "u", "x\r\n\r\nWARC/1.1\r\n"), (4, "u", ""), (4, "u", ""), (None, "a\r\nb", "é"), (None, None, "é"), (7, "u", "q" * 100_000)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, digest string")
    warc.write_warc(df, str(tmp_path / "a"))
    got = warc.transactions(warc.read_warc(spark, str(tmp_path / "a"))).collect()
    assert len(got) == len({r.record_id for r in got}) == 8 and all(r.request and r.metadata for r in got)
    page = lambda r: r.record_id.split(":")[2]
    of = lambda p: sorted((r.response.kind, r.response.refers_to_page, r.response.payload_bytes) for r in got if page(r) == p)
    assert of("1") == [("revisit", "3", 15)] and of("3") == [("response", None, 15)] and of("2") == [("revisit", "4", 0)]
    assert of("4") == [("response", None, 0)] * 2 and of("") == [("response", None, 2)] * 2 and of("7") == [("response", None, 100_000)]
    assert [bytes(r.response.payload).decode() for r in got if page(r) == "3"] == [rows[0][2]]
    assert sorted(map(str, warc.captures(spark, str(tmp_path / "a")).collect())) == sorted(map(str, got))
    warc.write_warc(df, str(tmp_path / "b"), least_bytes=10)
    small = [(page(r), r.response.kind) for r in warc.captures(spark, str(tmp_path / "b")).collect()]
    assert small.count(("2", "response")) == 1 and small.count(("1", "revisit")) == 1
    warc.write_warc(df.limit(0), str(tmp_path / "c"))
    assert warc.read_warc(spark, str(tmp_path / "c")).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en", "x", 0), (9002, "123", "en", "x", 3), (9003, "", None, None, None)], docs.schema)
    docs, before = docs.unionByName(extra), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF).cache()
        assert docs.columns == before.columns, name
        left, had = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.text for r in before.collect()}
        assert set(left) <= set(had)
        gone = set(had) - set(left)
        if name == "language":
            assert {9001, 9002, 9003} <= gone and len(gone) < 10
        elif name == "duplicates":
            sets = {k: set(shingle_hashes(words(t)).tolist()) for k, t in had.items()}
            assert gone and all(any(k != o and len(sets[k] & sets[o]) / len(sets[k] | sets[o]) >= 0.8 for o in had if sets[o]) for k in gone)
            kept = [sets[k] for k in left]
            assert not any(len(a & b) / len(a | b) >= 0.8 for i, a in enumerate(kept) for b in kept[:i])
        elif name == "decontamination":
            items = [" ".join(words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert all(k in gone for k, t in had.items() if any(f" {i} " in f" {' '.join(words(t))} " for i in items))
        else:
            assert not gone and all("@mail" not in t for t in left.values())
            assert docs.where(F.col("n_chars") != F.length("text")).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}


def test_pipeline_runs_on_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
