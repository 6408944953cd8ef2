"""Operator 13: a trie of conversations' common beginnings, by partition refinement."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordering import running_totals
from .common import bound_batches, n_partitions, written

#: Turns of a sequence in one row.
TURNS_A_ROW = 64
#: Bytes of ids in one row, on their way to a digest.
IDS_A_ROW = 1 << 20


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of conversation, with the task's number and their place in what the task has of the conversation, from 1."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        ids = batch.column("conv_id").to_numpy(zero_copy_only=False)
        new = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))) if len(ids) else np.empty(0, np.int64)
        place = np.arange(len(ids)) - np.repeat(new, np.diff(np.append(new, len(ids)))) + 1
        if len(ids):
            if last == ids[0]:
                place[: new[1] if len(new) > 1 else len(ids)] += seen
            last, seen = ids[-1], int(place[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(ids), part, np.int32)), pa.array(place)], [*batch.schema.names, "part", "place"])


def ordered_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, k1, k2, bytes): turns in order, from 1; k1 and k2 are 128 bits of role and text, bytes the text's UTF-8 length.

    Null turns come first, rows of one turn stand in order of their digest; equal rows are a turn each; null roles and
    texts are empty; rows without conv_id are no conversation and are left out; other columns, whatever their names,
    are not read. Texts are digested where they stand. Rows are sorted over all tasks by conversation and turn, so a
    conversation with very many turns is cut over tasks like any other rows; what one task has of it is counted, and
    the counts of earlier tasks, two rows a task, are added.
    """
    spark = df.sparkSession
    bound_batches(spark)
    r, t = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    rows = df.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.xxhash64(r, t).alias("k1"), F.xxhash64(F.lit(13), t, r).alias("k2"), F.octet_length(t).cast("long").alias("bytes")).where("conv_id is not null")
    n = n_partitions(spark, 40 * df.count(), 32 << 20)
    order = ("conv_id", F.asc_nulls_first("turn"), "k1", "k2")
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", "k1", "k2", "bytes")
    placed = written(dealt.mapInArrow(_places, "conv_id long, k1 long, k2 long, bytes long, part int, place long"), "turns")
    # A task's first conversation may have begun in the tasks before it: there it was the last one.
    ends = placed.groupBy("part").agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("last"), F.max_by("place", F.struct("conv_id", "place")).alias("n"))
    asked = ends.select("part", F.col("first").alias("conv_id"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("asks"))
    both = asked.unionByName(ends.select("part", F.col("last").alias("conv_id"), "n", F.lit(False).alias("asks")))
    earlier = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rangeBetween(Window.unboundedPreceding, -1))
    offset = both.withColumn("offset", earlier).where("asks and offset > 0").select("part", "conv_id", "offset")
    out = placed.join(F.broadcast(offset), ["part", "conv_id"], "left")  # a row a task at most
    return out.select("conv_id", (F.col("place") + F.coalesce("offset", F.lit(0))).alias("pos"), "k1", "k2", "bytes")


def rebuilt(turns: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) after every conversation c has got the first h turns of conversation c - c % every instead of its own first h.

    h is the CRC-32 of c's decimal digits modulo `most`. A conversation to begin with that doesn't exist gives no turns,
    a short one all it has. conversations has (conv_id, n), turnless ones included. Beginnings are `most` - 1 turns of a
    conversation at most, and go to `every` - 1 others at most.
    """
    convs = written(turns.groupBy("conv_id").agg(F.count("*").alias("own")), "conversations")
    own_place = F.pmod("conv_id", F.lit(every))
    base = F.col("conv_id") - own_place
    h = F.when(own_place == 0, 0).otherwise(F.crc32(F.col("conv_id").cast("string").cast("binary")) % most)
    heads = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    known = convs.withColumn("base", base).withColumn("h", h).join(heads, "base", "left").withColumn("m", F.least("h", F.coalesce("there", F.lit(0))))
    known = written(known.select("conv_id", "h", "m", (F.col("m") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), "rebuilt")
    taken = turns.where((F.col("pos") < most) & (own_place == 0)).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(every - 1))))
    taken = taken.withColumn("conv_id", F.try_add("conv_id", "k")).drop("k").withColumn("taken", F.lit(True))
    both = turns.withColumn("taken", F.lit(False)).unionByName(taken).join(known, "conv_id")
    kept = both.where(F.when(F.col("taken"), F.col("pos") <= F.col("h")).otherwise(F.col("pos") > F.col("h")))
    pos = F.when(F.col("taken"), F.col("pos")).otherwise(F.col("pos") - F.col("h") + F.col("m"))
    return written(kept.select("conv_id", pos.alias("pos"), "k1", "k2", "bytes"), "rebuilt-turns"), known.select("conv_id", "n")


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (rep, conv_id) to rows (rep, first, ids): the ids of a stretch, as decimals with commas between them."""
    rep, first, ids, size = None, 0, [], 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([first], pa.int64()), pa.array([",".join(ids)])], ["rep", "first", "ids"])

    for batch in batches:
        for r, c in zip(batch.column("rep").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if ids and (r != rep or size > IDS_A_ROW):
                yield row()
                ids, size = [], 0
            if not ids:
                rep, first = r, c
            ids.append(str(c))
            size += len(ids[-1]) + 1
    if ids:
        yield row()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (rep, first, ids) to (rep, ends_sha256), with one stretch in hand at a time."""
    rep, sha = None, None
    reps, out = [], []
    for batch in batches:
        for r, ids in zip(batch.column("rep").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if r == rep:
                sha.update(b"," + ids.encode())
                continue
            if sha is not None:
                reps.append(rep)
                out.append(sha.hexdigest())
            rep, sha = r, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(out, pa.string())], ["rep", "ends_sha256"])
        reps, out = [], []
    if sha is not None:
        yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([sha.hexdigest()])], ["rep", "ends_sha256"])


def id_digests(members: DataFrame) -> DataFrame:
    """(rep, ends_sha256) of rows (rep, conv_id): SHA-256 of a group's decimal ids, ascending, with commas between them.

    A group's bytes have to pass one task, as SHA-256 takes them in order; it gets them as few long rows, which many
    tasks have joined, and holds one at a time.
    """
    spark = members.sparkSession
    n = n_partitions(spark, 16 * members.count(), 32 << 20)
    joined = members.select("rep", "conv_id").repartitionByRange(n, "rep", "conv_id").sortWithinPartitions("rep", "conv_id").mapInArrow(_joined_ids, "rep long, first long, ids string")
    return joined.repartition(n, "rep").sortWithinPartitions("rep", "first").mapInArrow(_digests, "rep long, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns has (conv_id, pos from 1, k1, k2, bytes), conversations (conv_id, n turns). A node is a distinct sequence of
    first d turns; its members begin with it. saved_tokens adds up (n_convs - 1) * bytes over a node's subtree,
    ends_sha256 digests the ids of the members that end there (none: of the empty string).

    Equal conversations are one sequence with a weight. All sequences start in one class. A round takes the next turn,
    splits each class by it, and writes a row for each class that comes out; a class of one sequence is retired, and so
    is a sequence that has ended. Retired sequences give the nodes of their tails, a chain without branches, from their
    own turns. Then what classes and tails add is folded back along their paths to the root. So there are as many rounds as the longest
    beginning that two different sequences share, each over the sequences that still share theirs: partial counts are
    taken before each shuffle, and joins read tables on both sides, so that Spark can split the rows of a hot class.

    A conversation without turns ends at the root; equal conversations are members each; no conversations give no rows.
    """
    spark = turns.sparkSession
    bound_batches(spark)
    # Equal sequences: the same number of turns and the same 128 bits over all of them.
    bits = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "pos", "k1", "k2"))
    own = turns.groupBy("conv_id").agg(bits(1).alias("d1"), bits(2).alias("d2"))
    whole = written(conversations.join(own, "conv_id", "left").fillna(0, ["d1", "d2"]), "sequences")
    alike = ["d1", "d2", "n"]
    reps = written(whole.groupBy(*alike).agg(F.min("conv_id").alias("rep"), F.count("*").alias("w")), "distinct")
    top = reps.agg(F.min("rep").alias("rep"), F.sum("w").alias("w")).first()
    if top["rep"] is None:
        return spark.createDataFrame([], NODES)
    # The members of groups of copies; all others are their own.
    copies = written(whole.join(reps.where("w > 1"), alike).select("rep", "conv_id"), "copies")
    digests = reps.where("w = 1").select("rep", F.sha2(F.col("rep").cast("string"), 256).alias("ends_sha256")).unionByName(id_digests(copies))

    block = F.floor((F.col("pos") - 1) / TURNS_A_ROW)
    kept = turns.join(reps.select(F.col("rep").alias("conv_id"), "w", "n"), "conv_id")
    rows = kept.groupBy(F.col("conv_id").alias("rep"), "w", "n", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "k1", "k2", "bytes"))).alias("t"))
    at = written(rows.withColumn("block", F.col("block").cast("int")), "turn-blocks")

    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    ended, classes = [], []
    path = F.array(F.lit(top["rep"]))  # of a sequence: the smallest member of each node from the root to its class
    active, depth = reps.withColumn("path", path).select("path", "rep", "w", "n"), 0
    while True:
        ends_here, active = active.where(F.col("n") == depth), active.where(F.col("n") > depth)
        ended.append(ends_here.select("rep", F.element_at("path", -1).alias("conv_id"), F.lit(depth).cast("long").alias("depth")))
        if depth % TURNS_A_ROW == 0:
            active = written(active.select("path", "rep", "w", "n").join(at.where(F.col("block") == depth // TURNS_A_ROW).select("rep", "t"), "rep"), "active")
        turn = F.col("t")[depth % TURNS_A_ROW]
        split = active.withColumn("class", F.element_at("path", -1)).withColumn("k1", turn["k1"]).withColumn("k2", turn["k2"])
        measures = [F.min("rep").alias("conv_id"), F.sum("w").alias("w"), F.count("*").alias("n_seq"), F.min(turn["bytes"]).alias("bytes"), F.min("n").alias("n"), F.first("path").alias("path")]
        children = written(split.groupBy("class", "k1", "k2").agg(*measures), "classes")
        depth += 1
        classes.append(children.drop("k1", "k2").withColumn("depth", F.lit(depth).cast("long")))
        alive = children.where("n_seq > 1")
        if alive.isEmpty():
            break
        nexts = alive.select("class", "k1", "k2", F.col("conv_id").alias("next"))
        active = written(split.join(nexts, ["class", "k1", "k2"]).select(F.concat("path", F.array("next")).alias("path"), "rep", "w", "n", "t"), "active")

    union = lambda frames: frames[0] if len(frames) == 1 else union([*(a.unionByName(b) for a, b in zip(frames[::2], frames[1::2], strict=False)), *(frames[-1:] if len(frames) % 2 else [])])
    all_classes = union(classes)
    # Tails: each turn from the one that made the class single, with what the turns from it on would save.
    single = written(all_classes.where("n_seq = 1").select(F.col("conv_id").alias("rep"), F.col("depth").alias("from"), F.col("class").alias("parent"), "path"), "retired")
    own_turns = at.join(single.drop("path"), "rep").where((F.col("block") + 1) * TURNS_A_ROW >= F.col("from"))
    sized = own_turns.withColumn("t", F.filter("t", lambda x: x["pos"] >= F.col("from"))).withColumn("size", F.aggregate("t", zero, lambda s, x: s + x["bytes"]))
    heavy = written(sized.where("w > 1").select("rep", "w", "n", "from", "parent", "block", "t", "size"), "tails")
    total = heavy.groupBy("rep").agg(F.sum("size").alias("total"))
    before = running_totals(heavy, "block", {"earlier": F.col("size")}, by=("rep",)).join(total, "rep")
    spread = sized.where("w = 1").withColumn("earlier", zero).withColumn("total", zero).select(before.columns).unionByName(before)
    rest = lambda x: F.col("total") - F.col("earlier") - F.aggregate(F.filter("t", lambda y: y["pos"] < x["pos"]), zero, lambda s, y: s + y["bytes"])
    saved = lambda x: F.when(F.col("w") == 1, zero).otherwise((F.col("w") - 1) * rest(x))
    tails = spread.select("rep", "w", "n", "from", "parent", F.inline(F.transform("t", lambda x: F.struct(x["pos"].alias("depth"), saved(x).alias("saved_tokens")))))
    is_end = F.col("depth") == F.col("n")
    tails = tails.select(
        F.col("rep").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("from"), F.col("parent")).otherwise(F.col("rep")).alias("parent_conv_id"), F.col("w").alias("n_convs"),
        F.when(is_end, zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), "saved_tokens", F.when(is_end, F.col("rep")).alias("ends"), (F.col("depth") == F.col("from")).alias("is_top"),
    )
    tails = written(tails, "tail-nodes")

    # Fold back: what a class adds goes to each node on its path, and so does what a tail adds from where it begins. A
    # path is no longer than the turns of each sequence on it, so these rows are no more than all turns.
    node = lambda depth, conv_id, parent, w, kids, leaves, add: F.struct(*(x.alias(n) for x, n in ((depth, "depth"), (conv_id, "conv_id"), (parent, "parent"), (w, "w"), (kids, "kids"), (leaves, "leaves"), (add, "saved"))))
    nothing = F.lit(None).cast("long")
    along = lambda leaves, add: F.transform("path", lambda c, k: node(k.cast("long"), c, nothing, nothing, zero, leaves, add))
    kid = node(F.col("depth") - 1, F.col("class"), nothing, nothing, one, zero, zero)
    own_cost = (F.col("w") - 1) * F.col("bytes")
    inner = node(F.col("depth"), F.col("conv_id"), F.col("class"), F.col("w"), zero, zero, own_cost)
    is_class = F.col("n_seq") > 1
    adds = all_classes.select(F.inline(F.when(is_class, F.concat(F.array(kid, inner), along(zero, own_cost))).otherwise(F.array(kid))))
    begun = tails.where("is_top").select(F.col("conv_id").alias("rep"), "saved_tokens").join(single.select("rep", "path"), "rep")
    adds = adds.unionByName(begun.select(F.inline(along(one, F.col("saved_tokens")))))
    root = spark.range(1).select(F.inline(F.array(node(zero, F.lit(top["rep"]), nothing, F.lit(top["w"]).cast("long"), zero, zero, zero))))
    sums = adds.unionByName(root).groupBy("depth", "conv_id").agg(F.max("parent").alias("parent_conv_id"), F.max("w").alias("n_convs"), F.sum("kids").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    folded = sums.withColumn("n_leaves", F.when(F.col("n_children") == 0, one).otherwise(F.col("n_leaves")))
    nodes = folded.join(union(ended).select("conv_id", "depth", F.col("rep").alias("ends")), ["conv_id", "depth"], "left")
    nodes = written(nodes.unionByName(tails.drop("is_top")), "nodes")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    named = nodes.join(digests.withColumnRenamed("rep", "ends"), "ends").unionByName(nodes.where("ends is null").withColumn("ends_sha256", none))
    return named.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(ordered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


#: Each conversation's first d turns as a path of digests, nodes as groups of these, subtrees as paths that go on.
SQL = """
WITH ordered AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
bytes AS (SELECT c, list_transform(range(len(CAST(c AS VARCHAR))), lambda i: ascii(substr(CAST(c AS VARCHAR), i + 1, 1))) AS b FROM (SELECT DISTINCT c FROM ordered)),
h AS (SELECT c, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(b, lambda x: CAST(x AS BIGINT))), lambda crc, x:
  list_reduce(list_prepend(xor(crc, x), CAST(range(8) AS BIGINT[])), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, CAST(3988292384 AS BIGINT)) ELSE y >> 1 END)), CAST(4294967295 AS BIGINT)) % 9 AS h FROM bytes),
joined AS (SELECT h.c, o.p, o.role, o.text, 0 AS own FROM h JOIN ordered o ON o.c = h.c - h.c % 5 AND o.p <= h.h UNION ALL SELECT o.c, o.p, o.role, o.text, 1 FROM ordered o JOIN h ON o.c = h.c AND o.p > h.h),
turns AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, p) AS d, md5(concat(len(role), ':', role, text)) AS k, octet_length(encode(text)) AS b FROM joined),
paths AS (SELECT c, d, b, string_agg(k, '') OVER (PARTITION BY c ORDER BY d) AS path FROM turns UNION ALL SELECT c, 0, 0, '' FROM h),
n AS (SELECT c, max(d) AS n FROM paths GROUP BY c),
nodes AS (SELECT path, d AS depth, min(c) AS conv_id, count(*) AS n_convs, min(b) AS b, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n.n = d), '')) AS ends_sha256 FROM paths JOIN n USING (c) GROUP BY path, d),
below AS (SELECT a.path, count(*) FILTER (b.depth = a.depth + 1) AS n_children, sum((b.n_convs - 1) * b.b) AS saved_tokens FROM nodes a JOIN nodes b ON starts_with(b.path, a.path) GROUP BY a.path),
leaves AS (SELECT a.path, count(*) AS n_leaves FROM nodes a JOIN (SELECT path FROM below WHERE n_children = 0) b ON starts_with(b.path, a.path) GROUP BY a.path)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, v.n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM nodes v JOIN below USING (path) JOIN leaves USING (path) LEFT JOIN nodes u ON u.depth = v.depth - 1 AND starts_with(v.path, u.path)"""
