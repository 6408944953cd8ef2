"""Operator 3: token ids as Parquet list columns, for selective reads of tokens and metadata."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, documents, n_partitions, shared_path, text_bytes, tidy

#: Files grow beyond part_bytes rather than be more than these: so a row for each is small enough to broadcast, whatever the input.
MOST_FILES = 1 << 20
SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"


def encoder(path: str, end_id: int | None, id_column: str):
    """A mapInArrow function: rows (id, text) to SCHEMA, with the running number of ids in the partition."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .pieces import shared_encoder

        pieces = shared_encoder(path, keep_ids=True)
        end = b"" if end_id is None else end_id.to_bytes(4, "little")
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            packed = [x + end for x in pieces.grouped(batch.column("text").to_pylist())]
            n = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
            offsets = np.concatenate(([0], np.cumsum(n)))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(id_column), pa.array(np.full(len(n), part, np.int32)), pa.array(before + offsets[:-1]), pa.array(n), ids], ["doc_id", "part", "part_start", "n_tokens", "ids"])
            before += int(offsets[-1])

    return tidy(encode, tokenizes=True)


def write_tokens(df: DataFrame, at: str, tokenizer_path: str, end_id: int | None = 1, id_column: str = "doc_id", text: str = "text", part_bytes: int = 32 << 20, group_bytes: int = 16 << 20, page_bytes: int = 256 << 10) -> None:
    """Writes one Parquet file per range of ids, in ascending order of id, to `at`.

    Token ids are a list column with a dictionary (a vocabulary's ids fit one), metadata are delta-encoded; row groups
    and pages are bounded in bytes, and page indexes let a reader skip to the ids it wants. Texts are dealt by range
    of id (and of the start of the text, so that rows without id are dealt as well) once, before they are encoded. A
    null text is empty (its list holds the end id alone); null ids sort first; rows that share an id stand in order of
    their text; a very long text is one list; other columns, whatever their names, are not read; an empty table gives an
    empty folder that reads back as no rows.
    """
    spark = df.sparkSession
    bound_batches(spark)
    docs = df.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = min(MOST_FILES, n_partitions(spark, text_bytes(docs), part_bytes))
    ordered = docs.repartitionByRange(n, "doc_id", F.substring("text", 1, 16)).sortWithinPartitions("doc_id", "text")
    (
        ordered.mapInArrow(encoder(tokenizer_path, end_id, "doc_id"), SCHEMA)
        .write.option("parquet.block.size", group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#ids.list.element", "true")
        .option("parquet.dictionary.page.size", 1 << 20)
        .option("compression", "zstd")
        .parquet(at)
    )


def read_tokens(spark: SparkSession, at: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) of files by write_tokens; start is the number of ids before the document.

    Only what is selected is read: metadata without ids, or the ids of some documents by a filter on doc_id. Files are
    added up in groups of 1,024, so one window has a row per file of a group, the other a row per group; what is
    broadcast is a row of 16 bytes for each of at most MOST_FILES files, so that ids are never dealt.
    """
    rows = spark.read.schema(SCHEMA).parquet(at)
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("group", F.shiftright("part", 10))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = files.groupBy("group").agg(F.sum("n").alias("n")).select("group", before(Window.orderBy("group")).alias("group_base"))
    files = files.withColumn("own_base", before(Window.partitionBy("group").orderBy("part"))).join(groups, "group")
    bases = files.select("part", (F.col("group_base") + F.col("own_base")).alias("base"))
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def _crc32(ids: pa.Array) -> pa.Array:
    """CRC-32 of a list of ids as little-endian unsigned 32-bit integers."""
    ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4")
    return pa.array([zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.int64())


def ids_crc32():
    return F.arrow_udf(_crc32, "long")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    at = shared_path(spark, "tokens")
    write_tokens(documents(spark, sf_dir), at, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, at).select("doc_id", "start", "n_tokens", ids_crc32()("ids").alias("ids_crc32"))
