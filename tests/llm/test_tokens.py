"""Operators 1, 3 and 10 against the tokenizers library itself."""

import functools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from conftest import SF
from sieveline.llm import packing, token_counts, token_files
from sieveline.llm.pieces import PieceEncoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [" ", " ", "\n", "\t", "a", "B", "foo", "été", "é", "é", "'s", "1", "23", "!", "!!", "$$$", "<|endoftext|>", "<|startoftext|>", " ", "\x1c", "　", "Σ", "  ", "\r\n", "漢", "😀", ".", "'", "\x85", ",", "foo,", "Bar.", "İ", "ß", "_"]
ROWS = [(1, "hello world"), (2, None), (3, ""), (4, "a b\n c  <|endoftext|> x"), (4, "hello world"), (None, "hello"), (5, "word " * 3000), (1, "hello world")]


loaded = functools.lru_cache(Tokenizer.from_file)


def library(path, text, end=()):
    return [*loaded(path).encode(text or "", add_special_tokens=False).ids, *end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("keep", [True, False])
def test_pieces_equal_the_library(path, keep):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(4000)] + ["", "x" * 5000, " " * 300, "\n\n", None]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = list(PieceEncoder(path, keep, max_pieces=500).grouped(texts, group_bytes=2000))
    assert ([np.frombuffer(g, "<u4").tolist() for g in got] == want) if keep else (got == [len(w) for w in want])


def test_other_tokenizers_go_through_the_library(tmp_path):
    import json

    texts = ["hello world  foo", " a b", "", None, "x\ny"]
    for name, change in (("prefix", lambda j: j["pre_tokenizer"].update(add_prefix_space=True)), ("added", lambda j: j["added_tokens"].append(dict(j["added_tokens"][0], id=50257, content="hello")))):
        with open(BYTE, encoding="utf-8") as f:
            settings = json.load(f)
        change(settings)
        at = tmp_path / f"{name}.json"
        at.write_text(json.dumps(settings))
        encoder = PieceEncoder(str(at), True)
        assert not encoder.cut and PieceEncoder(BYTE, True).cut
        assert [np.frombuffer(g, "<u4").tolist() for g in encoder.grouped(texts)] == [library(str(at), t) for t in texts]


def test_counts(spark):
    df = spark.createDataFrame([(*r, 7, 8) for r in ROWS], "doc_id long, text string, n_tokens int, extra int")
    got = token_counts.count_tokens(df, BYTE).collect()
    assert [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got] == [(i, len((t or "").encode()), n := len(library(BYTE, t)), n > 512) for i, t in ROWS]
    assert token_counts.count_tokens(df.limit(0), BYTE).count() == 0


def test_count_query(spark):
    got = {r.doc_id: r for r in token_counts.op1_token_counts(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        assert got[r.doc_id].n_tokens == len(library(BYTE, r.text)) and got[r.doc_id].n_bytes == len(r.text.encode())


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(*r, 7) for r in ROWS], "doc_id long, text string, start int")
    token_files.write_tokens(df, str(tmp_path / "a"), WORD)
    got = sorted(token_files.read_tokens(spark, str(tmp_path / "a")).collect(), key=lambda r: r.start)
    want, at = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), 0
    for r, (i, t) in zip(got, want, strict=True):
        ids = library(WORD, t, (1,))
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, at, len(ids), ids)
        at += len(ids)
    token_files.write_tokens(df.limit(0), str(tmp_path / "b"), WORD)
    assert token_files.read_tokens(spark, str(tmp_path / "b")).count() == 0


def test_files_are_encoded_for_selective_reads(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    token_files.write_tokens(docs, str(tmp_path / "a"), WORD, part_bytes=64 << 10)
    for at in (files := glob.glob(str(tmp_path / "a" / "*.parquet"))):
        for g in range(pq.ParquetFile(at).metadata.num_row_groups):
            own = {(c := pq.ParquetFile(at).metadata.row_group(g).column(k)).path_in_schema: c for k in range(5)}
            ids = own["ids.list.element"]
            assert "RLE_DICTIONARY" in ids.encodings and ids.has_offset_index and ids.has_column_index
            assert "DELTA_BINARY_PACKED" in own["doc_id"].encodings and own["doc_id"].has_column_index
    assert len(files) > 3
    some = token_files.read_tokens(spark, str(tmp_path / "a")).where("doc_id = 7").select("doc_id", "ids")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(doc_id,7)" in plan
    assert some.first()["ids"] == library(WORD, docs.where("doc_id = 7").first()["text"], (1,))
    narrow = token_files.read_tokens(spark, str(tmp_path / "a")).select("doc_id", "start")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in "".join(x for x in narrow.split("\n") if "ReadSchema" in x)


def test_file_query(spark):
    got, at = sorted(token_files.op3_token_files(spark, SF).collect(), key=lambda r: r.doc_id), 0
    for r, d in zip(got, spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect(), strict=True):
        ids = library(WORD, d.text, (1,))
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(ids), crc(ids))
        at += len(ids)


def check_packing(pieces, ids_of, limits):
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    for key, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids_of[key])
            assert p.ids_crc32 == crc(ids_of[key][at : at + p.length])
            at += p.length
        assert at == len(ids_of[key])
    assert set(by_doc) == set(ids_of)
    short = 0
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= limits.tokens and len(own) <= limits.segments
        short += at != limits.tokens and at & (at - 1) != 0
    return short


def test_pack_query(spark):
    ids_of = {r.doc_id: library(BYTE, r.text, (1,)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert check_packing(packing.op10_packing(spark, SF).collect(), ids_of, packing.Limits()) == 0


def test_short_texts_leave_little_padding(spark):
    df = spark.createDataFrame([(k, f"a b c {k}") for k in range(5000)], "doc_id long, text string").repartition(2)
    pieces = packing.pack_documents(df, BYTE).collect()
    tokens, size = sum(p.length for p in pieces), {}
    for p in pieces:
        size[p.sequence_id] = size.get(p.sequence_id, 0) + p.length
    padded = sum(0 if n & (n - 1) == 0 else 2048 - n for n in size.values())
    assert padded < 0.05 * tokens


def test_pack_edges(spark):
    from pyspark.sql import functions as F

    rows = [(1, ""), (2, None), (3, "x y " * 4000), (4, "a"), (None, "b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int").coalesce(1)
    got = packing.pack_documents(df, BYTE).withColumn("ids_crc32", F.crc32("ids")).collect()
    assert check_packing(got, {i: library(BYTE, t, (1,)) for i, t in rows}, packing.Limits()) == 0
    assert packing.pack_documents(df.limit(0), BYTE).count() == 0


def test_pack_limits():
    rng = random.Random(3)
    limits = packing.Limits(tokens=64, segments=4, loss=40)
    packer, rows = packing.Packer(limits, 8, 0), []
    items = {k: np.array([rng.random() < 0.6 for _ in range(rng.randint(1, 100))], np.uint8) for k in range(200)}
    for k, mask in items.items():
        rows += packer.add(packing.Item(k, np.arange(len(mask), dtype="<u4").tobytes(), mask))
    rows += packer.finish()
    for k, mask in items.items():
        own = sorted((r[1], r[2]) for r in rows if r[0] == k)
        assert sum(n for _, n in own) == len(mask) and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
    for s in {r[4] for r in rows}:
        own = [r for r in rows if r[4] == s]
        assert sum(r[2] for r in own) <= 64 and len(own) <= 4 and sum(int(items[r[0]][r[1] : r[1] + r[2]].sum()) for r in own) <= 40


def test_pack_conversations(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    roles = {(r.conv_id, r.turn): r.role for r in turns.collect()}
    limits = packing.Limits(512, 8, 200)
    got = packing.pack_conversations(turns, BYTE, limits=limits).collect()
    bears = {}
    for conv in {c for c, _ in roles}:
        own = turns.where(turns.conv_id == conv).orderBy("turn", "role").collect()
        bears[conv] = np.concatenate([np.full(len(library(BYTE, r.text, (1,))), r.role == "assistant") for r in own])
    loss, tokens, segments = {}, {}, {}
    for p in got:
        s = p.sequence_id
        loss[s] = loss.get(s, 0) + int(bears[p.doc_id][p.start : p.start + p.length].sum())
        tokens[s], segments[s] = tokens.get(s, 0) + p.length, segments.get(s, 0) + 1
    assert max(loss.values()) == 200 and max(tokens.values()) <= 512 and max(segments.values()) <= 8
    assert sum(tokens.values()) == sum(map(len, bears.values()))


def test_conversations_of_odd_rows(spark):
    rows = [(1, None, "assistant", "first"), (1, 1, "user", None), (1, 1, "user", None), (None, 1, "user", "alone"), (None, 1, "assistant", "alone too"), (2, 0, None, "word " * 5000)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, doc_id int").repartition(3)
    got = packing.pack_conversations(df, BYTE).collect()
    whole = {}
    for p in sorted(got, key=lambda p: (str(p.doc_id), p.doc_tokens, p.start)):
        whole[p.doc_id, p.doc_tokens] = whole.get((p.doc_id, p.doc_tokens), b"") + bytes(p.ids)
    want = {1: [*library(BYTE, "first", (1,)), 1, 1], 2: library(BYTE, "word " * 5000, (1,))}
    assert {k[0]: np.frombuffer(v, "<u4").tolist() for k, v in whole.items() if k[0]} == want
    assert sorted(np.frombuffer(v, "<u4").tolist() for k, v in whole.items() if k[0] is None) == sorted(library(BYTE, t, (1,)) for t in ("alone", "alone too"))
    assert packing.pack_conversations(df.limit(0), BYTE).count() == 0


def test_instruction_query_is_bound_by_its_limits(spark):
    got = packing.instruction_packing(spark, "/root/testdata/sf0.01").collect()
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").orderBy("conv_id", "turn", "role", "text").collect()
    bears, sizes = {}, {}
    for r in turns:
        n = len(library(BYTE, r.text, (1,)))
        bears.setdefault(r.conv_id, []).append(np.full(n, r.role == "assistant"))
        sizes[r.conv_id] = sizes.get(r.conv_id, 0) + n
    bears = {c: np.concatenate(b) for c, b in bears.items()}
    assert {c: sum(p.length for p in got if p.conv_id == c) for c in sizes} == sizes
    loss, tokens = {}, {}
    for p in got:
        tokens[p.sequence_id] = tokens.get(p.sequence_id, 0) + p.length
        loss[p.sequence_id] = loss.get(p.sequence_id, 0) + int(bears[p.conv_id][p.start : p.start + p.length].sum())
    assert max(tokens.values()) <= 2048 and max(loss.values()) == 1024  # loss binds before tokens do
