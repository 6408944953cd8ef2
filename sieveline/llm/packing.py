"""Operator 10: vector bin packing of examples into training sequences."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, documents, n_partitions, text_bytes, tidy

PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


@dataclass(frozen=True)
class Limits:
    """Of one sequence: tokens, segments (pieces) and tokens that bear loss.

    By default only tokens bind: plain documents bear loss everywhere, and short ones may share a sequence as they come.
    """

    tokens: int = 2048
    segments: int = 2048
    loss: int = 2048


#: For instruction data: a sequence also ends with its 32nd segment, or when half of it bears loss.
INSTRUCTIONS = Limits(segments=32, loss=1024)


@dataclass
class Item:
    """What is left of an example: ids from `start`, and for each id whether it bears loss (None: all do)."""

    key: int | None
    ids: bytes
    mask: np.ndarray | None
    start: int = 0

    def __post_init__(self):
        self.n = len(self.ids) // 4
        self.upto = None if self.mask is None else np.concatenate(([0], np.cumsum(self.mask)))

    @property
    def left(self) -> int:
        return self.n - self.start

    def loss(self, length: int) -> int:
        return length if self.upto is None else int(self.upto[self.start + length] - self.upto[self.start])

    def fitting(self, tokens: int, loss: int) -> int:
        """The longest prefix within both limits."""
        k = min(self.left, tokens)
        if self.upto is not None and self.loss(k) > loss:
            return int(np.searchsorted(self.upto, self.upto[self.start] + loss, "right")) - 1 - self.start
        return min(k, loss) if self.upto is None else k


class Packer:
    """Fills one sequence at a time from a pool of examples.

    Of the examples that fit whole, the next is the one whose demand (tokens, a segment, loss) has the largest dot
    product with what the sequence still offers, each as a share of its limit. If none fits, or only one segment is
    left, the example that fills most is cut. So a sequence is full unless a limit other than tokens ends it. What
    the partition's last sequence holds is dealt over sequences whose lengths are powers of two.
    """

    def __init__(self, limits: Limits, pool: int, first_id: int):
        self.limits, self.pool_size, self.next_id = limits, pool, first_id
        self.pool: list[Item] = []
        self.left = np.zeros(pool + 1, np.int64)
        self.left_loss = np.zeros(pool + 1, np.int64)
        self.open: list[tuple[Item, int, int]] = []
        self.used = np.zeros(3, np.int64)

    def add(self, item: Item) -> Iterator[tuple]:
        k = len(self.pool)
        self.pool.append(item)
        self.left[k], self.left_loss[k] = item.left, item.loss(item.left)
        while len(self.pool) > self.pool_size:
            yield from self.place()

    def finish(self) -> Iterator[tuple]:
        while self.pool:
            yield from self.place()
        yield from self.tail()

    def place(self) -> Iterator[tuple]:
        """Puts one piece from the pool into the open sequence; gives the sequence's rows when it is full."""
        limit, n = self.limits, len(self.pool)
        tokens, segments, loss = limit.tokens - int(self.used[0]), limit.segments - int(self.used[1]), limit.loss - int(self.used[2])
        left, left_loss = self.left[:n], self.left_loss[:n]
        whole = (left <= tokens) & (left_loss <= loss)
        if segments > 1 and whole.any():
            dot = left / limit.tokens * (tokens / limit.tokens) + left_loss / limit.loss * (loss / limit.loss) + segments / limit.segments**2
            k = int(np.argmax(np.where(whole, dot, -1.0)))
        else:
            k = int(np.argmax(np.minimum(left, tokens) - np.maximum(left_loss - loss, 0)))
        item = self.pool[k]
        take = item.fitting(tokens, loss)
        if take:
            self.open.append((item, item.start, take))
            self.used += (take, 1, item.loss(take))
            item.start += take
            if item.left:
                self.left[k], self.left_loss[k] = item.left, item.loss(item.left)
            else:
                last = self.pool.pop()
                if k < len(self.pool):
                    self.pool[k], self.left[k], self.left_loss[k] = last, left[n - 1], left_loss[n - 1]
        if not take or self.used[0] == limit.tokens or self.used[1] == limit.segments or self.used[2] == limit.loss:
            yield from self.close()

    def close(self) -> Iterator[tuple]:
        offset = 0
        for item, start, take in self.open:
            yield item.key, start, take, item.n, self.next_id, offset, item.ids[4 * start : 4 * (start + take)]
            offset += take
        self.next_id += bool(self.open)
        self.open, self.used = [], np.zeros(3, np.int64)

    def tail(self) -> Iterator[tuple]:
        rest, self.open, self.used = self.open, [], np.zeros(3, np.int64)
        total, k = sum(take for _, _, take in rest), 0
        while total:
            room = 1 << (total.bit_length() - 1)
            total -= room
            while room:
                item, start, take = rest[k]
                part = min(take, room)
                self.open.append((item, start, part))
                rest[k] = (item, start + part, take - part)
                room -= part
                k += part == take
            yield from self.close()


def packed(examples: DataFrame, limits: Limits = Limits(), pool: int = 128, prepare=None) -> DataFrame:
    """Packs rows (doc_id, ids binary, mask binary) into sequences; one row of PIECE per piece.

    ids are little-endian unsigned 32-bit integers, mask has a byte per id (1: it bears loss) or is null (all do).
    prepare, if given, turns other rows of examples into such examples within the same task: it takes the Arrow batches
    and yields (doc_id, ids, mask).
    Each partition is packed on its own as it streams by, with `pool` examples at hand: no shuffle, nothing but the
    pool and one sequence in memory, and only a partition's last sequence falls short of full. sequence_id starts
    with the partition's number, so a task that runs again after a lost executor gives the same rows. Examples
    without ids have no piece. Repeated rows are packed each; a null doc_id stays null; no rows give no pieces; other
    columns, whatever their names, are not read. A very long example is held whole and fills sequences one after the
    other. Of examples with the same dot product the first in the pool is taken.
    """

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "mask")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, rows, size = Packer(limits, pool, TaskContext.get().partitionId() << 33), [], 0
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        for key, ids, mask in (prepare or plain)(batches):
            if ids:
                for row in packer.add(Item(key, ids, None if mask is None else np.frombuffer(mask, np.uint8))):
                    rows.append(row)
                    size += len(row[-1])
            if size > 4 << 20:
                yield batch_of(rows)
                rows, size = [], 0
        rows += packer.finish()
        if rows:
            yield batch_of(rows)

    return examples.mapInArrow(tidy(run, tokenizes=True), PIECE)


def _tokens(path: str, end_id: int | None):
    """For `packed`: rows (doc_id, text) to examples whose tokens all bear loss."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        from .pieces import shared_encoder

        pieces = shared_encoder(path, keep_ids=True)
        end = b"" if end_id is None else end_id.to_bytes(4, "little")
        for batch in batches:
            for key, ids in zip(batch.column("doc_id").to_pylist(), pieces.grouped(batch.column("text").to_pylist()), strict=True):
                yield key, ids + end, None

    return prepare


def pack_documents(df: DataFrame, tokenizer_path: str, end_id: int = 1, limits: Limits = Limits()) -> DataFrame:
    """Packs the texts of df (doc_id, text), each with the end id after it; all tokens bear loss. A null text is empty."""
    bound_batches(df.sparkSession)
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return packed(rows, limits, prepare=_tokens(tokenizer_path, end_id))


def _turns(path: str, end_id: int, roles: tuple[str, ...]):
    """For `packed`: sorted rows (conv_id, role, text) to an example a conversation, of whose tokens those of `roles` bear loss."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        from .pieces import shared_encoder

        pieces = shared_encoder(path, keep_ids=True)
        end, key, ids, mask = end_id.to_bytes(4, "little"), None, [], []
        for batch in batches:
            convs, who = (batch.column(c).to_pylist() for c in ("conv_id", "role"))
            for conv, role, own in zip(convs, who, pieces.grouped(batch.column("text").to_pylist()), strict=True):
                if ids and (conv != key or conv is None):
                    yield key, b"".join(ids), b"".join(mask)
                    ids, mask = [], []
                key = conv
                ids.append(own + end)
                mask.append((b"\1" if role in roles else b"\0") * (len(ids[-1]) // 4))
        if ids:
            yield key, b"".join(ids), b"".join(mask)

    return prepare


def pack_conversations(df: DataFrame, tokenizer_path: str, end_id: int = 1, limits: Limits = INSTRUCTIONS, roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Packs instruction data: turns (conv_id, turn, role, text), where only turns of `roles` bear loss.

    A conversation's turns are joined in order of turn (null first; ties: role, text), each with the end id after it. They
    are dealt and sorted by Spark and tokenized as they stream by, so a task holds one conversation's ids at a time,
    however long it is. A row without conv_id is an example of its own, with a null doc_id; a null text is empty, a null
    role bears no loss; repeated rows are turns each; no rows give no pieces; other columns, whatever their names, are
    not read.
    """
    spark = df.sparkSession
    bound_batches(spark)
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    # Rows without conv_id need no company, so they are dealt by what they say.
    dealt = rows.repartition(n_partitions(spark, text_bytes(rows), 32 << 20), F.coalesce("conv_id", F.xxhash64("text", "turn")))
    ordered = dealt.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text").select("conv_id", "role", "text")
    return packed(ordered, limits, prepare=_turns(tokenizer_path, end_id, roles))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def instruction_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as instruction data: sequences end with 2,048 tokens, 32 segments or 1,024 tokens that bear loss, whichever comes first."""
    import public_tokenizers

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    pieces = pack_conversations(turns, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(F.col("doc_id").alias("conv_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), F.col("doc_tokens").alias("conv_tokens"), "sequence_id", "offset")
