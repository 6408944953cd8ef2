"""Operator 6: n-gram Jaccard join by MinHash bands, verified on whole n-gram sets.

1. One scan gives each text the digest of its set of word shingles and its band hashes. Texts with the same set are one
   node from here on: copies are counted, never paired.
2. Each node is compared with a representative: of the bands it shares, the smallest node. Then each node with one
   representative of every band where not all belong together yet. So a group of n near copies takes a few n comparisons.
3. What is left in a band, without its representative, is compared in blocks; only texts that no link has joined meet.
   So each two texts that share a band have been compared or are of one class.
4. Links are counted within the classes: a task gets two blocks of a class and counts, by a matrix product, how many
   shingles each pair has in common. It returns a number for each node, not pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, documents, fresh, frugal, tidy, tidy_group, written
from .components import components
from .shingles import SHINGLE, mix, shingle_hashes, words

#: Nodes that meet one copy of a representative; one that more are compared with is dealt in several copies.
MEET = 1024


def plan_bands(least: float, recall: float = 0.999, most_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most selective banding that finds a pair of similarity `least` with this probability."""
    for rows in range(32, 0, -1):
        p = least**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows <= most_hashes or rows == 1:
            return bands, rows
    raise AssertionError


def band_hashes(shingles: np.ndarray, bands: int, rows: int, seed: int = 1) -> np.ndarray:
    """One 64-bit hash per band of a MinHash signature of bands * rows permutations."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[None, at : at + 2048]
        for k in range(0, len(a), 16):
            least[k : k + 16] = np.minimum(least[k : k + 16], (part * a[k : k + 16, None] + b[k : k + 16, None]).min(1))
    out = np.zeros(bands, np.uint64)
    for row in mix(least).reshape(bands, rows).T:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + row)
    return mix(out + np.arange(bands, dtype=np.uint64))


def node_of(shingles: np.ndarray) -> bytes:
    """The digest of a sorted set of shingles."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(words(text), size))


def signer(bands: int, rows: int, size: int):
    """A mapInArrow function: (doc_id, k, row, text) to (doc_id, k, row, node, n, bands); no node where a text has no words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, ns, hashes = [], [], []
            for t in batch.column("text").to_pylist():
                h = shingle_set(t, size)
                nodes.append(node_of(h) if len(h) else None)
                ns.append(len(h))
                hashes.append(band_hashes(h, bands, rows).view(np.int64).tolist() if len(h) else None)
            own = [batch.column(c) for c in ("doc_id", "k", "row")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(nodes, pa.binary()), pa.array(ns, pa.int32()), pa.array(hashes, pa.list_(pa.int64()))], ["doc_id", "k", "row", "node", "n", "bands"])

    return tidy(sign)


def set_maker(size: int):
    """A mapInArrow function: (node, text) to (node, set), the text's sorted shingles; texts of other nodes are left out."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(n, h) for n, t in zip(*(batch.column(c).to_pylist() for c in ("node", "text")), strict=True) if node_of(h := shingle_set(t, size)) == n]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.binary()), pa.array([h.tobytes() for _, h in found], pa.binary())], ["node", "set"])

    return tidy(make)


def jaccard(a: Column, b: Column) -> Column:
    """Of two columns of shingle sets as bytes."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        frugal()
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            shared = len(np.intersect1d(x, y, assume_unique=True))
            out.append(shared / (len(x) + len(y) - shared))
        return pa.array(out, pa.float64())

    return F.arrow_udf(run, "double")(a, b)


def shared_counts(a: list[np.ndarray], b: list[np.ndarray], columns: int = 1 << 11) -> np.ndarray:
    """How many shingles each set of a shares with each set of b, by products of 0/1 matrices of bounded width."""
    out = np.zeros((len(a), len(b)), np.float32)
    flat = [np.concatenate(s) for s in (a, b)]
    common = np.intersect1d(*flat)
    if not len(common):
        return out
    sides = []
    for s, f in zip((a, b), flat, strict=True):
        row = np.repeat(np.arange(len(s), dtype=np.int32), [len(x) for x in s])
        at = np.minimum(np.searchsorted(common, f), len(common) - 1)
        own = common[at] == f
        at, row = at[own], row[own]
        order = np.argsort(at, kind="stable")
        sides.append((at[order], row[order], len(s)))
    for lo in range(0, len(common), columns):
        wide, m = min(columns, len(common) - lo), []
        for at, row, n in sides:
            own = slice(*np.searchsorted(at, (lo, lo + wide)))
            m.append(np.zeros((n, wide), np.float32))
            m[-1][row[own], at[own] - lo] = 1
        out += m[0] @ m[1].T
    return out


def linked_pairs(a: list[np.ndarray], b: list[np.ndarray], least: float) -> np.ndarray:
    """Whether the sets of a and b are linked, as a matrix."""
    shared, n = shared_counts(a, b), [np.array([len(x) for x in s]) for s in (a, b)]
    return shared >= least * (n[0][:, None] + n[1][None, :] - shared) - 1e-6


def _sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(v, np.uint64) for v in column.to_pylist()]


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those pairs (node, rep, c) that are linked; c bounds how many nodes a representative is compared with.

    A representative that more than MEET nodes are compared with is dealt in as many copies as needed.
    """
    copies = lambda c: F.ceil(c / MEET).cast("int")
    reps = pairs.groupBy("rep").agg(F.max("c").alias("c"))
    dealt = sets.select(F.col("node").alias("rep"), F.col("set").alias("rep_set")).join(reps, "rep")
    dealt = dealt.select("rep", "rep_set", F.explode(F.sequence(F.lit(0), copies(F.col("c")) - 1)).alias("copy"))
    met = pairs.join(sets, "node").withColumn("copy", F.pmod(F.xxhash64("node"), copies(F.col("c"))).cast("int"))
    return met.join(dealt, ["rep", "copy"]).where(jaccard(F.col("set"), F.col("rep_set")) >= least - 1e-9).drop("set", "rep_set", "copy")


def forest(least: float):
    """An applyInArrow function over a unit of work (band, side, root, node, set): links that join roots, one tree each.

    The nodes of a band on side 0 are compared with each other and with those on side 1.
    """

    @tidy_group
    def run(table: pa.Table) -> pa.Table:
        got = table.select(["band", "side", "root", "node"]).to_pandas()
        got["set"] = _sets(table.column("set"))
        out = []
        for _, part in got.sort_values(["band", "side", "node"], kind="stable").groupby("band", sort=False):
            root, node, sets = part.root.tolist(), part.node.tolist(), part.set.tolist()
            few = int((part.side == 0).sum())
            if not few or len(set(root)) < 2:
                continue
            near = linked_pairs(sets[:few], sets, least)
            label = np.unique(np.array(root, object), return_inverse=True)[1]
            for i in range(few):
                for j in np.flatnonzero(near[i] & (label != label[i])).tolist():
                    if label[i] != label[j]:
                        out.append((root[i], root[j]))
                        label[label == label[j]] = label[i]
        return pa.table({"a": pa.array([a for a, _ in out], pa.binary()), "b": pa.array([b for _, b in out], pa.binary())})

    return run


def unsettled_units(rest: DataFrame, block_nodes: int, block_words: int) -> DataFrame:
    """(node, band, root, side, unit): the units of work of rows (node, band, root, n) of bands with several roots.

    In each band the nodes of its most frequent root need not meet each other. The others are dealt over blocks; a block
    is a unit (side 0), and every other block of its band comes to it once (side 1).
    """
    by_root = rest.groupBy("band", "root").agg(F.count("*").alias("nodes"), F.sum("n").alias("words"))
    first = by_root.groupBy("band").agg(F.max(F.struct("nodes", "words", "root")).alias("most"), F.sum("nodes").alias("nodes"), F.sum("words").alias("words"))
    blocks = lambda nodes, words: F.greatest(F.ceil(nodes / block_nodes), F.ceil(words / block_words)).cast("int")
    few = first.select("band", F.col("most.root").alias("most"), blocks(F.col("most.nodes"), F.col("most.words")).alias("m"), blocks(F.col("nodes") - F.col("most.nodes"), F.col("words") - F.col("most.words")).alias("f"))
    placed = rest.join(few, "band").withColumn("minor", F.col("root") != F.col("most"))
    at = F.pmod(F.xxhash64("node"), F.when(F.col("minor"), F.col("f")).otherwise(F.col("m"))).cast("int")
    placed = placed.withColumn("at", at).withColumn("own", F.explode(F.sequence(F.lit(0), F.col("f") - 1)))
    # A row of the most frequent root goes to every minor block; a minor row to its own and to those before it. Of the
    # former, each block goes to its own unit, so that a unit holds two blocks.
    placed = placed.where(~F.col("minor") | (F.col("own") <= F.col("at")))
    other = F.when(F.col("minor"), F.col("at")).otherwise(-1 - F.col("at"))
    side = F.when(F.col("minor") & (F.col("own") == F.col("at")), 0).otherwise(1)
    one = (F.col("f") == 1) & (F.col("m") == 1)
    dealt = placed.select("node", "band", "root", "f", "m", "own", side.alias("side"), other.alias("other"), one.alias("one"))
    # The block's own nodes come to each of its units.
    hosts = dealt.where("side = 0 and not one").withColumn("other", F.explode(F.concat(F.sequence(-F.col("m"), F.lit(-1)), F.sequence(F.col("own"), F.col("f") - 1))))
    large = dealt.where("side = 1 and not one").union(hosts.select(dealt.columns))
    name = F.concat_ws(":", F.hex("band"), "own", "other")
    small = dealt.where("one")
    bins = max(1, math.ceil(small.count() / block_nodes))
    out = ["node", "band", "root", "side"]
    return large.select(*out, name.alias("unit")).union(small.select(*out, F.concat(F.lit("s"), F.pmod(F.xxhash64("band"), F.lit(bins))).alias("unit")))


def class_labels(nodes: DataFrame, rows_in: DataFrame, least: float, size: int, block_nodes: int, block_words: int) -> tuple[DataFrame, DataFrame]:
    """((node, root), (node, set)): root is the same for nodes that links connect; nodes that share no band are left out.

    nodes: (node, k, n, bands); rows_in: (k, text).
    """
    banded = nodes.select("node", "n", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("c")).where("c > 1")
    # Of two tables, Spark can split the rows of a band that very many nodes have.
    shared = written(banded.join(written(hubs, "hubs").hint("merge"), "band"), "shared")
    # What is wanted grows with the corpus, so it is never broadcast, however small its files look.
    wanted = nodes.select("node", "k").join(shared.select("node").distinct(), "node")
    sets = rows_in.select("k", "text").join(wanted.hint("merge"), "k").select("node", "text").mapInArrow(set_maker(size), "node binary, set binary")
    sets = written(sets.dropDuplicates(["node"]), "sets")

    # First the smallest representative of each node, then one of every band in which roots differ.
    stars = shared.groupBy("node").agg(F.min(F.struct(F.col("hub").alias("rep"), "c")).alias("s")).where("node != s.rep").select("node", "s.*")
    stars = written(verified(stars, sets, least).select("node", F.col("rep").alias("root")), "stars")
    top = stars.select(F.col("node").alias("root"), F.col("root").alias("top"))
    early = stars.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    rooted = shared.select("node", "band").join(early, "node", "left").select("node", "band", F.coalesce("root", "node").alias("root"))
    rooted = written(rooted, "rooted")
    heads = written(several_roots(rooted), "heads")
    pairs = rooted.join(heads, "band").where("root != rep_root").groupBy("node", "rep").agg(F.max("c").alias("c"))
    more = verified(written(pairs, "pairs"), sets, least).select(F.col("node").alias("a"), F.col("rep").alias("b"))
    labels = components(stars.select(F.col("node").alias("a"), F.col("root").alias("b")).union(written(more, "more")))

    # A band's representative has met all others; the rest meets in blocks.
    joined = rooted.join(heads.select("band", "rep"), "band").where("node != rep").select("node", "band")
    joined = written(joined.join(labels, "node", "left").select("node", "band", F.coalesce("root", "node").alias("root")), "joined")
    rest = joined.join(several_roots(joined).select("band"), "band").join(nodes.select("node", "n"), "node")
    rest = written(rest.select("node", "band", "root", "n"), "rest")
    work = unsettled_units(rest, block_nodes, block_words)
    late = written(work.join(sets, "node").groupBy("unit").applyInArrow(forest(least), "a binary, b binary"), "late")
    return relabelled(labels, components(late)), sets


def several_roots(rooted: DataFrame) -> DataFrame:
    """(band, rep, rep_root, c) of the bands with several roots: a node of each, by hash, so that large classes give it."""
    rep = F.min(F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("rep"), F.col("root").alias("rep_root"))).alias("r")
    heads = rooted.groupBy("band").agg(rep, F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c")).where("lo != hi")
    return heads.select("band", "r.rep", "r.rep_root", "c")


def relabelled(labels: DataFrame, merged: DataFrame) -> DataFrame:
    """labels after their roots were merged: a root that had no node but itself may be among the merged."""
    top = merged.select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = labels.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    alone = merged.join(labels.select("node"), "node", "left_anti").select("node", "root")
    return written(moved.union(alone), "labels")


def block_counter(least: float):
    """An applyInArrow function over a unit of packed blocks (root, a, b, own, nodes, copies, sets): each block's numbers of links there.

    A unit has blocks a and b of a class, or whole small classes; (root, own, links), links a number for each node.
    """

    @tidy_group
    def run(table: pa.Table) -> pa.Table:
        out = []
        got = table.select(["root", "own", "copies"]).to_pandas()
        got["sets"] = [[np.frombuffer(x, np.uint64) for x in v] for v in table.column("sets").to_pylist()]
        for root, part in got.sort_values(["root", "own"], kind="stable").groupby("root", sort=False):
            own, sets, copies = part.own.tolist(), part.sets.tolist(), [np.asarray(c, np.int64) for c in part.copies]
            near = linked_pairs(sets[0], sets[-1], least)
            if len(own) == 1:
                np.fill_diagonal(near, False)
                out.append((root, own[0], near @ copies[0]))
            else:
                out += [(root, own[0], near @ copies[1]), (root, own[1], copies[0] @ near)]
        return pa.table({"root": pa.array([r for r, _, _ in out], pa.binary()), "own": pa.array([k for _, k, _ in out], pa.int32()), "links": pa.array([n.tolist() for _, _, n in out], pa.list_(pa.int64()))})

    return run


def count_links(labels: DataFrame, nodes: DataFrame, sets: DataFrame, least: float, block_nodes: int, block_words: int) -> DataFrame:
    """(node, links): how many rows with another set each node of a class is linked to.

    A class is packed in blocks of about `block_nodes` nodes or `block_words` shingles, a row each; each two blocks meet
    in one task. So a class of n nodes takes n² / 2 comparisons, and as many rows as pairs of blocks.
    """
    member = written(labels.join(nodes.select("node", "n", "copies"), "node"), "member")
    by_root = member.groupBy("root").agg(F.count("*").alias("nodes"), F.sum("n").alias("words")).where("nodes > 1")
    blocks = by_root.select("root", F.greatest(F.ceil(F.col("nodes") / block_nodes), F.ceil(F.col("words") / block_words)).cast("int").alias("blocks"))
    placed = member.join(blocks, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    row = F.array_sort(F.collect_list(F.struct("node", "copies", "set")))
    packed = placed.join(sets, "node").groupBy("root", "blocks", "own").agg(row.alias("t"))
    packed = written(packed.select("root", "blocks", "own", F.col("t.node").alias("nodes"), F.col("t.copies").alias("copies"), F.col("t.set").alias("sets")), "packed")
    large = packed.where("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.concat_ws(":", F.hex("root"), F.least("own", "other"), F.greatest("own", "other"))
    small = packed.where("blocks = 1")
    bins = max(1, math.ceil(small.count() / 64))
    single = F.concat(F.lit("s"), F.pmod(F.xxhash64("root"), F.lit(bins)))
    units = large.select("root", "own", "copies", "sets", pair.alias("unit")).union(small.select("root", "own", "copies", "sets", single.alias("unit")))
    counted = written(units.groupBy("unit").applyInArrow(block_counter(least), "root binary, own int, links array<long>"), "counted")
    each = packed.select("root", "own", "nodes").join(counted, ["root", "own"]).select(F.explode(F.arrays_zip("nodes", "links")).alias("x"))
    return each.groupBy(F.col("x.nodes").alias("node")).agg(F.sum("x.links").alias("links"))


def _signed(docs: DataFrame, least: float, size: int, recall: float, key: str, text: str, row: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((k, text), (doc_id, k, row, node, n, bands) by row, (node, rep, k, copies, n, bands) by distinct set)."""
    bound_batches(docs.sparkSession)
    # k finds a text again, by its doc_id and what it says, so that rows that share an id aren't all met for each other's sake.
    own = F.col(key).cast("long")
    rows_in = docs.select(own.alias("doc_id"), F.xxhash64(own, text).alias("k"), row.alias("row"), F.col(text).alias("text"))
    signed = written(rows_in.mapInArrow(signer(*plan_bands(least, recall), size), "doc_id long, k long, row long, node binary, n int, bands array<long>"), "signed")
    first = [F.min("doc_id").alias("rep"), F.min("k").alias("k"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")]
    return rows_in, signed, written(signed.where("node is not null").groupBy("node").agg(*first), "nodes")


def near_duplicates(docs: DataFrame, least: float = 0.8, size: int = SHINGLE, recall: float = 0.999, key: str = "doc_id", text: str = "text", block_nodes: int = 1024, block_words: int = 1_000_000) -> DataFrame:
    """Rows (doc_id, class_id, n_links) for each row of docs.

    Two texts are linked if the Jaccard similarity of their sets of `size`-word shingles (lower case; a shorter text is
    one shingle) is at least `least`. n_links counts the other rows of its class that a row is linked to, copies
    included; class_id is the smallest doc_id of the rows that links connect, directly or not. Links are those of texts
    that share a band: at `least` with probability `recall`, above it with more.

    Texts without words (null, empty, blank) have no links, and their class is their own doc_id. A very long text is one
    set like any other, held whole by one task. Repeated rows are copies of each other; a null doc_id takes no part in
    class_id, which is null where a class has no other; an empty table gives no rows; other columns, whatever their
    names, are not read.
    """
    rows_in, signed, nodes = _signed(docs, least, size, recall, key, text, F.lit(0).cast("long"))
    labels, sets = class_labels(nodes, rows_in, least, size, block_nodes, block_words)
    links = count_links(labels, nodes, sets, least, block_nodes, block_words)
    least_id = labels.join(nodes.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("class_id"))
    about = nodes.select("node", "rep", "copies").join(labels.join(least_id, "root").select("node", "class_id"), "node", "left").join(links, "node", "left")
    n_links = F.col("copies") - 1 + F.coalesce("links", F.lit(0))
    about = written(about.select("node", F.coalesce("class_id", "rep").alias("class_id"), n_links.alias("n_links")), "about")
    found = signed.select("doc_id", "node").join(about, "node", "left")
    return found.select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, least: float = 0.8, size: int = SHINGLE, recall: float = 0.999, key: str = "doc_id", text: str = "text", block_nodes: int = 1024, block_words: int = 1_000_000) -> DataFrame:
    """One row of each class of docs: that with the smallest id, of several texts under that id the one with the smallest digest.

    Rows that share an id without being near copies are kept each, as each class keeps its own. Rows without words or
    without id all stay, save that rows with the same id that are equal in every column are one. Links aren't counted
    here, so the work follows the number of rows, however large a class is.
    """
    row = F.xxhash64(*(F.col(f"`{f.name}`").cast("string") if f.dataType.typeName() == "map" else F.col(f"`{f.name}`") for f in docs.schema))
    rows_in, signed, nodes = _signed(docs, least, size, recall, key, text, row)
    labels, _ = class_labels(nodes, rows_in, least, size, block_nodes, block_words)
    named = signed.where("doc_id is not null").select("doc_id", "row", "node")
    classed = named.where("node is not null").join(labels, "node", "left")
    best = classed.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("doc_id", "node", "row")).alias("b")).select("b.doc_id", "b.row")
    keep = written(best.union(named.where("node is null").select("doc_id", "row").distinct()), "keep")
    k, r = fresh(docs, "k"), fresh(docs, "r")
    kept = docs.where(F.col(key).isNotNull()).withColumn(k, F.col(key).cast("long")).withColumn(r, row)
    kept = kept.join(keep.select(F.col("doc_id").alias(k), F.col("row").alias(r)), [k, r], "left_semi").dropDuplicates([k, r])
    return kept.select(docs.columns).union(docs.where(F.col(key).isNull()))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
