"""Operator 7: bytes that repeat an earlier document, by column-wise suffix sorting of aligned contexts.

A window of WINDOW bytes repeats if the same bytes start in a document with a smaller doc_id. Three passes:

1. Anchors. A window's anchor is the K-gram in it with the least hash, so equal windows have the same anchor at the same
   place. Hashes of anchors are dealt by value; those that two documents share make candidates.
2. Columns. A candidate's context, the windows that have the anchor, goes to a bucket of its hash, aligned at the anchor.
   A bucket's contexts get one more symbol each round, from the last column to the first: the symbols in the order of
   the last round are the collection's Burrows-Wheeler column, from which follow the new order of suffixes and their
   common prefixes. Windows next to each other with a common prefix of WINDOW are equal; the smallest doc_id keeps them.
3. Removal. Each document takes out the bytes that its repeated windows cover.

Documents of one task that share an anchor or a whole context settle that among themselves, so a passage that a third of
all documents hold is sent on once a task. The contexts of an anchor that very many texts have are dealt as single
windows, by their own hash. What a bucket finds goes out in a packed row for each range of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, documents, free_shuffles, n_partitions, text_bytes, written
from .shingles import mix

WINDOW, K = 50, 24
LEAD = WINDOW - K  # the furthest that a window starts before its anchor
COLUMNS = LEAD + WINDOW
#: An anchor is frequent from so many places on, if they are a millionth of all bytes too: then at most so many anchors are.
FREQUENT, MOST_FREQUENT = 20_000, 1_000_000
_SLICE = 1 << 22
_BASE = 0x9E3779B97F4A7C15
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_LOW = np.uint64((1 << 24) - 1)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, first, last) of each anchor of a text: the windows from first to last have it."""
    parts = []
    for at in range(0, max(0, len(data) - WINDOW + 1), _SLICE):
        h = _BYTES[np.frombuffer(data[at : at + _SLICE + WINDOW - 1], np.uint8)]
        h2 = h[:-1] * _power(1) + h[1:]
        h4 = h2[:-2] * _power(2) + h2[2:]
        h8 = h4[:-4] * _power(4) + h4[4:]
        h16 = h8[:-8] * _power(8) + h8[8:]
        g = mix(h16[: len(h) - K + 1] * _power(8) + h8[16 : 16 + len(h) - K + 1])
        key = (g & ~_LOW) | np.arange(len(g), dtype=np.uint64)  # of equal hashes the leftmost
        m = key
        for step in (1, 2, 4, 8):
            m = np.minimum(m[:-step], m[step:])
        m = np.minimum(m[: len(g) - LEAD], m[LEAD - 15 : LEAD - 15 + len(g) - LEAD])
        place = (m & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.append(first[1:], len(place)) - 1
        parts.append((place[first] + at, g[place[first]], first + at, last + at))
    if not parts:
        none = np.empty(0, np.int64)
        return none, none.astype(np.uint64), none, none
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _packed(x: np.ndarray) -> bytes:
    """Bytes of the same weight together, so that zeros compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack_rows(keys: list[np.ndarray], values: list[np.ndarray], ranges: int) -> tuple[list[int], list[bytes]]:
    """Rows of 64-bit keys and 32-bit values as one packed row for each range that the last key falls in."""
    part = keys[-1] % ranges
    order = np.lexsort((*values[::-1], *keys, part))
    part = part[order]
    cut = np.flatnonzero(np.diff(part)) + 1
    out = []
    for own in np.split(order, cut) if len(order) else []:
        columns = [_packed(np.diff(k[own], prepend=0)) for k in keys] + [_packed(np.diff(v[own].astype(np.uint32), prepend=np.uint32(0))) for v in values]
        out.append(len(own).to_bytes(4, "little") + zstandard.compress(b"".join(columns), 1))
    return part[np.append(0, cut)].tolist() if len(order) else [], out


def rows_in(data: bytes) -> int:
    """How many rows a packed row holds."""
    return int.from_bytes(data[:4], "little")


def unpack_rows(data: bytes, keys: int, values: int) -> list[np.ndarray]:
    n, raw, at, out = rows_in(data), zstandard.decompress(data[4:]), 0, []
    for kind in [np.int64] * keys + [np.uint32] * values:
        size = n * np.dtype(kind).itemsize
        out.append(np.cumsum(_unpacked(raw[at : at + size], kind), dtype=kind))
        at += size
    return out


def merger(keys: int, values: int, names: list[str]):
    """An applyInArrow function over the packed rows of a range: a row for each key, with its values as bytes."""

    def merge(table: pa.Table) -> pa.Table:
        got = [np.concatenate(c) for c in zip(*(unpack_rows(d, keys, values) for d in table.column("data").to_pylist()), strict=True)]
        order = np.lexsort(got[:keys])
        key, value = [c[order] for c in got[:keys]], np.stack([c[order] for c in got[keys:]], 1)
        first = np.flatnonzero(np.concatenate(([True], np.any([np.diff(c) != 0 for c in key], 0))))
        last = np.append(first[1:], len(order))
        own = [value[a:b].tobytes() for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        return pa.table([*(pa.array(c[first], pa.int64()) for c in key), pa.array(own, pa.binary())], names)

    return merge


def _blob(hashes: np.ndarray, owners: np.ndarray, places: np.ndarray, keys: np.ndarray) -> bytes:
    """Anchors of one bucket, compressed: rising hashes, owners as numbers in keys, places."""
    columns = [_packed(np.diff(hashes, prepend=np.uint64(0))), _packed(owners), _packed(places), keys.tobytes()]
    return zstandard.compress(np.array([len(hashes), len(places)], np.uint32).tobytes() + b"".join(columns), 1)


def _unblobbed(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.decompress(blob)
    n_hashes, n = (int(x) for x in np.frombuffer(raw[:8], np.uint32))
    at, out = 8, []
    for kind, many in ((np.uint64, n_hashes), (np.uint32, n_hashes), (np.uint32, n)):
        size = many * np.dtype(kind).itemsize
        out.append(_unpacked(raw[at : at + size], kind))
        at += size
    return np.cumsum(out[0], dtype=np.uint64), out[1], out[2], np.frombuffer(raw[at:], np.int64)


def anchor_blobs(buckets: int, bits: int, most: int = 1 << 20):
    """A mapInArrow function: (k, text) to (bucket, blob).

    Anchors that two texts of the same lot share are candidates already: their places go out under their own key (no
    hashes), and one of them, without owner, goes to the bucket so that others learn of it; its place is their number.
    """
    names, types, none = ["bucket", "blob"], [pa.int32(), pa.binary()], np.empty(0, np.uint32)

    def lot(keys: list[int], found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        key = np.array(keys, np.int64)
        owner = np.repeat(np.arange(len(found), dtype=np.uint32), [len(p) for p, _ in found])
        place = np.concatenate([p for p, _ in found]).astype(np.uint32)
        v = np.concatenate([h for _, h in found]) >> np.uint64(64 - bits)
        order = np.lexsort((v // np.uint64(buckets), v % np.uint64(buckets)))
        v, owner, place = v[order], owner[order], place[order]
        start = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
        run = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(v))))
        shared = (np.minimum.reduceat(key[owner], start) != np.maximum.reduceat(key[owner], start))[run]
        rows = []
        known = np.flatnonzero(shared)
        known = known[np.argsort(owner[known], kind="stable")]
        for part in np.split(known, np.flatnonzero(np.diff(owner[known])) + 1) if len(known) else []:
            k = int(key[owner[part[0]]])
            rows.append((k % buckets, _blob(none.astype(np.uint64), none, place[part], key[owner[part[:1]]])))
        first = np.zeros(len(v), bool)
        first[start] = True
        sent = np.flatnonzero(~shared | first)
        number = np.diff(np.append(start, len(v))).astype(np.uint32)[run]
        place = np.where(shared, number, place)
        bucket = (v[sent] % np.uint64(buckets)).astype(np.int64)
        for part in np.split(sent, np.flatnonzero(np.diff(bucket)) + 1):
            own, at = np.unique(owner[part], return_inverse=True)
            at = np.where(shared[part], np.uint32(0xFFFFFFFF), at.astype(np.uint32))
            rows.append((int(v[part[0]] % np.uint64(buckets)), _blob(v[part] // np.uint64(buckets), at, place[part], key[own])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, found, n = [], [], 0
        for batch in batches:
            for k, text in zip(batch.column("k").to_pylist(), batch.column("text").to_pylist(), strict=True):
                place, h, _, _ = anchors(text.encode())
                if len(place):
                    keys.append(k)
                    found.append((place, h))
                    n += len(place)
                if n >= most:
                    yield lot(keys, found)
                    keys, found, n = [], [], 0
        if found:
            yield lot(keys, found)

    return run


def shared_anchors(buckets: int, ranges: int):
    """An applyInArrow function over a bucket's blobs: packed (k, place), n in a row, of the anchors that other texts have too, by range of k.

    Under range -1, packed (anchor, number of places) of those that are at FREQUENT places or more.
    """

    def find(table: pa.Table) -> pa.Table:
        out_k, out_place, often = [], [], ([], [])
        hashes, keys, places = [], [], []
        for h, owner, place, key in map(_unblobbed, table.column("blob").to_pylist()):
            if not len(h):
                out_k.append(np.full(len(place), key[0]))
                out_place.append(place)
                continue
            hashes.append(h)
            places.append(place)
            known = owner == 0xFFFFFFFF
            keys.append((np.append(key, 0)[np.where(known, len(key), owner)], known))
        if hashes:
            h, place = np.concatenate(hashes), np.concatenate(places)
            key, known = np.concatenate([k for k, _ in keys]), np.concatenate([n for _, n in keys])
            order = np.argsort(h, kind="stable")
            h, place, key, known = h[order], place[order], key[order], known[order]
            start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            hit = np.logical_or.reduceat(known, start) | (np.minimum.reduceat(key, start) != np.maximum.reduceat(key, start))
            kept = np.repeat(hit, np.diff(np.append(start, len(h)))) & ~known
            out_k.append(key[kept])
            out_place.append(place[kept])
            number = np.add.reduceat(np.where(known, place, 1).astype(np.int64), start)
            many = np.flatnonzero(number >= FREQUENT)
            own = np.uint64(table.column("bucket")[0].as_py())
            often = (h[start[many]] * np.uint64(buckets) + own).view(np.int64), number[many].clip(max=2**32 - 1)
        found, data = pack_rows([np.concatenate(out_k)], [np.concatenate(out_place)], ranges) if out_k else ([], [])
        if len(often[0]):
            data += pack_rows([often[0]], [often[1]], 1)[1]
            found = [*found, -1]
        return pa.table({"range": pa.array(found, pa.int32()), "n": pa.array([rows_in(d) for d in data], pa.int64()), "data": pa.array(data, pa.binary())})

    return find


_KINDS = (("doc", np.int64), ("k", np.int64), ("anchor", np.int32), ("lead", np.uint8), ("size", np.uint8))


def _bundle(rows: list[tuple[int, int, int, int, bytes]]) -> bytes:
    """Contexts (doc, k, anchor, lead, data) of one bucket, compressed column by column."""
    doc, k, anchor, lead, data = zip(*rows, strict=True)
    columns = [np.array(c, t).tobytes() for c, (_, t) in zip((doc, k, anchor, lead, list(map(len, data))), _KINDS, strict=True)]
    return len(rows).to_bytes(4, "little") + zstandard.compress(b"".join(columns) + b"".join(data), 1)


def _unbundled(blob: bytes) -> tuple[list[np.ndarray], bytes]:
    n, raw, at, columns = int.from_bytes(blob[:4], "little"), zstandard.decompress(blob[4:]), 0, []
    for _, t in _KINDS:
        columns.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return columns, raw[at:]


def contexts(buckets: int, frequent: np.ndarray, bits: int, lot_bytes: int = 24 << 20):
    """A mapInArrow function: (doc, k, text, places) to (bucket, doc, k, data), the contexts of each bucket in a bundle.

    Contexts of frequent anchors (of `bits` bits) are cut into their windows, which are dealt by their own hash.

    Of a lot's equal contexts those of the smallest doc are sent; the others repeat it, which they tell at once: such
    rows have a doc and runs of window starts.
    """
    names, types = ["bucket", "doc", "k", "data"], [pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def lot(found: dict[tuple[bytes, int], list[tuple[int, int, int, int]]]) -> pa.RecordBatch:
        sent, repeated = {}, {}
        for (context, lead), who in found.items():
            if len(who) > 1:
                who = sorted(set(who))  # rows that are the same in all have the same contexts
            least = who[0][0]
            for doc, k, anchor, bucket in who:
                if doc == least:
                    sent.setdefault(bucket, []).append((doc, k, anchor, lead, context))
                else:
                    repeated.setdefault((doc, k), []).append((anchor - lead, len(context) - WINDOW + 1))
        rows = [(bucket, None, None, _bundle(some)) for bucket, some in sent.items()]
        rows += [(k % buckets, doc, k, np.array(some, np.uint32).tobytes()) for (doc, k), some in repeated.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = {}, 0
        for batch in batches:
            for doc, k, text, places in zip(*(batch.column(c).to_pylist() for c in ("doc", "k", "text", "places")), strict=True):
                data = text.encode()
                place, h, first, last = anchors(data)
                own = np.flatnonzero(np.isin(place, np.frombuffer(places, np.uint32)))
                bucket = (h[own] % np.uint64(buckets)).astype(np.int64)
                parts = list(zip(place[own].tolist(), bucket.tolist(), first[own].tolist(), (last[own] + WINDOW).tolist(), strict=True))
                if len(frequent) and (hot := np.isin(h[own] >> np.uint64(64 - bits), frequent)).any():
                    windows = [(a, None, x, x + WINDOW) for (a, _, s, e), cut in zip(parts, hot.tolist(), strict=True) if cut for x in range(s, e - WINDOW + 1)]
                    parts = [p for p, cut in zip(parts, hot.tolist(), strict=True) if not cut] + windows
                for a, b, s, e in parts:
                    context = data[s:e]
                    key = context, a - s
                    who = doc, k, a, xxhash.xxh3_64_intdigest(context) % buckets if b is None else b
                    if (got := found.get(key)) is None:
                        found[key] = [who]
                        size += e - s + 100
                    else:
                        got.append(who)
                        size += 100
                if size > lot_bytes:
                    yield lot(found)
                    found, size = {}, 0
        if found:
            yield lot(found)

    return run


def _equal_rows(rows: np.ndarray) -> np.ndarray:
    """For each row of a byte matrix the number of a row that equals it, the same for all equal rows."""
    weight = mix(np.arange(rows.shape[1], dtype=np.uint64) + np.uint64(_BASE)) | np.uint64(1)
    h = np.zeros(len(rows), np.uint64)
    for c in range(rows.shape[1]):
        h += (rows[:, c].astype(np.uint64) + np.uint64(1)) * weight[c]
    _, first, at = np.unique(mix(h), return_index=True, return_inverse=True)
    same = first[at]
    wrong = np.flatnonzero((rows != rows[same]).any(1))  # equal hashes of unequal rows stay on their own
    same[wrong] = wrong
    return same


def equal_windows(symbols: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Column by column from the last, (column, order, starts of groups) of the rows whose WINDOW symbols from there on are equal.

    symbols has a column per row of the matrix, 0 outside a context. order sorts the rows' suffixes, common has the
    common prefix of each with the one before it, both as of the column to the right; the column's symbols in that
    order are what a Burrows-Wheeler transform of the collection has there. A stable sort by them is the new order,
    and the least common prefix between two rows of one symbol, plus 1, their new common prefix.
    """
    n = symbols.shape[1]
    order, common = np.arange(n), np.zeros(n, np.int16)
    for column in range(len(symbols) - 1, -1, -1):
        transform = symbols[column][order]
        move = np.argsort(transform, kind="stable")
        moved, longer = transform[move], np.zeros(n, np.int16)
        start = np.concatenate(([0], np.flatnonzero(np.diff(moved)) + 1))
        for lo, hi in zip(start.tolist(), np.append(start[1:], n).tolist(), strict=True):
            if hi - lo > 1 and moved[lo]:
                part = move[lo:hi]
                longer[lo + 1 : hi] = np.minimum.reduceat(common[: part[-1] + 1], part[:-1] + 1) + 1
        order, common = order[move], longer
        if column <= LEAD:
            yield column, order, np.flatnonzero(common < WINDOW)


def repeated_windows(ranges: int):
    """An applyInArrow function over a bucket's contexts: packed (doc, k, start, n) of the windows that a smaller doc has too, by range of k."""

    def find(table: pa.Table) -> pa.Table:
        hits, columns, flat = [], [], []  # hits: doc, k, first window, windows
        for doc, k, data in zip(*(table.column(c).to_pylist() for c in ("doc", "k", "data")), strict=True):
            if doc is None:
                own, raw = _unbundled(data)
                columns.append(own)
                flat.append(raw)
            else:
                start, n = np.frombuffer(data, np.uint32).reshape(-1, 2).T
                hits.append((np.full(len(n), doc), np.full(len(n), k), start, n))
        if columns:
            hits += _equal_contexts([np.concatenate(c) for c in zip(*columns, strict=True)], b"".join(flat))
        doc, k, start, n = (np.concatenate(c) for c in zip(*hits, strict=True)) if hits else [np.empty(0, np.int64)] * 4
        found, data = pack_rows([doc, k], [start, n], ranges)
        return pa.table({"range": pa.array(found, pa.int32()), "data": pa.array(data, pa.binary())})

    return find


def _equal_contexts(columns: list[np.ndarray], raw: bytes) -> list[tuple[np.ndarray, ...]]:
    """Of contexts (doc, k, anchor, lead, size) and their bytes: (doc, k, first window, windows) that a smaller doc has too."""
    doc, k, anchor, lead, size = columns
    anchor, lead, size, n = anchor.astype(np.int64), lead.astype(np.int64), size.astype(np.int64), len(doc)
    raw = np.frombuffer(raw, np.uint8)
    row = np.repeat(np.arange(n), size)
    column = np.arange(len(raw)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(LEAD - lead, size)
    rows = np.zeros((n, COLUMNS + 2), np.uint8)
    rows[row, column], rows[:, -2], rows[:, -1] = raw, lead, size
    same = _equal_rows(rows)
    # Equal contexts are one from here on, the smallest doc's; in the others all windows repeat.
    first, at = np.unique(same, return_inverse=True)
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, at, doc)
    hit = np.flatnonzero(doc > least[at])
    hits = [(doc[hit], k[hit], (anchor - lead)[hit], (size - WINDOW + 1)[hit])]
    symbols = np.ascontiguousarray(rows[first, :COLUMNS].T).astype(np.uint16) + 1
    at_column = np.arange(COLUMNS)[:, None]
    symbols[(at_column < LEAD - lead[first]) | (at_column >= (LEAD - lead + size)[first])] = 0
    member = np.argsort(at, kind="stable")
    member = member[doc[member] == least[at[member]]]  # of each context the rows of its smallest doc
    member_at = np.searchsorted(at[member], np.arange(len(first) + 1))
    for c, order, group in equal_windows(symbols):
        if len(group) < len(order):
            top = np.repeat(np.minimum.reduceat(least[order], group), np.diff(np.append(group, len(order))))
            u = order[least[order] > top]
            n_own = member_at[u + 1] - member_at[u]
            own = member[np.repeat(member_at[u] - (np.cumsum(n_own) - n_own), n_own) + np.arange(n_own.sum())]
            hits.append((doc[own], k[own], anchor[own] + c - LEAD, np.ones(len(own), np.int64)))
    return hits


def removal():
    """An Arrow function from (text, its runs) to (n_bytes, n_removed, n_spans, kept: the bytes left)."""

    def remove(texts: pa.Array, found: pa.Array) -> pa.Array:
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for text, some in zip(texts.to_pylist(), found.to_pylist(), strict=True):
            data = text.encode()
            removed = spans = 0
            if some:
                change = np.zeros(len(data) + 1, np.int32)
                first, n = np.frombuffer(some, np.uint32).reshape(-1, 2).astype(np.int64).T
                np.add.at(change, first, 1)
                np.add.at(change, first + n - 1 + WINDOW, -1)
                gone = np.cumsum(change[:-1]) > 0
                removed, spans = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                rest = np.frombuffer(data, np.uint8)[~gone].tobytes()
            else:
                rest = data
            n_bytes.append(len(data))
            n_removed.append(removed)
            n_spans.append(spans)
            kept.append(rest)
        return pa.StructArray.from_arrays([pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], ["n_bytes", "n_removed", "n_spans", "kept"])

    return F.arrow_udf(remove, "struct<n_bytes:long,n_removed:long,n_spans:long,kept:binary>")


def most_frequent(candidates: DataFrame, size: int) -> np.ndarray:
    """The anchors at FREQUENT places or more, and at a millionth of all bytes or more: so at most MOST_FREQUENT."""
    least = max(FREQUENT, size / MOST_FREQUENT)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data").to_pylist():
                anchor, n = unpack_rows(data, 1, 1)
                yield pa.RecordBatch.from_arrays([pa.array(anchor[n >= least], pa.int64())], ["anchor"])

    found = candidates.where("range = -1").select("data").mapInArrow(pick, "anchor long").collect()
    return np.array([r.anchor for r in found], np.int64).view(np.uint64)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept) for each row of docs.

    kept is what is left of the text's UTF-8 bytes when those are removed that a window of WINDOW bytes covers which
    also starts in a row with a smaller doc_id. A null text is empty; a null doc_id counts as larger than all others;
    rows that share a doc_id don't remove from each other; an empty table gives no rows; other columns, whatever their
    names, are not read. A very long text is anchored in slices and held whole, like any other, where bytes are removed.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1)).alias("doc"), F.xxhash64(F.col(key), F.xxhash64(whole)).alias("k"), whole.alias("text"))
    size = text_bytes(rows)
    free_shuffles(spark)
    buckets = ranges = max(64, n_partitions(spark, size, 24 << 20))
    bits = min(64, max(36, size.bit_length() + 12))
    long_enough = rows.where(F.octet_length("text") >= WINDOW)
    blobs = long_enough.select("k", "text").mapInArrow(anchor_blobs(buckets, bits), "bucket int, blob binary")
    candidates = written(blobs.groupBy("bucket").applyInArrow(shared_anchors(buckets, ranges), "range int, n long, data binary"), "candidates")
    frequent = most_frequent(candidates, size)

    n = candidates.where("range >= 0").agg(F.sum("n").alias("n")).first()["n"] or 0
    free_shuffles(spark)
    lots = n_partitions(spark, int(n), 60_000)
    by_text = candidates.where("range >= 0").groupBy("range").applyInArrow(merger(1, 1, ["k", "places"]), "k long, places binary")
    aligned = long_enough.select("doc", "k", "text").join(by_text, "k").mapInArrow(contexts(lots, frequent, bits), "bucket int, doc long, k long, data binary")
    repeated = written(aligned.groupBy("bucket").applyInArrow(repeated_windows(ranges), "range int, data binary"), "repeated")
    repeated.isEmpty()
    free_shuffles(spark)

    found = repeated.groupBy("range").applyInArrow(merger(2, 2, ["doc", "k", "runs"]), "doc long, k long, runs binary")
    out = rows.join(found, ["doc", "k"], "left").select("doc_id", removal()("text", "runs").alias("r"))
    return out.select("doc_id", "r.*")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: The same rows in DuckDB's SQL, window by window: some seconds for a megabyte of text.
SQL = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5_number(x[2 * i + 1 : 2 * i + 100]) AS g FROM d, unnest(range(greatest(n - 49, 0))) u(i)),
f AS (SELECT g, min(doc_id) AS first FROM w GROUP BY g),
r AS (SELECT doc_id, i FROM w JOIN f USING (g) WHERE doc_id > first),
s AS (SELECT doc_id, i, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) > 50 AS new FROM r),
g AS (SELECT doc_id, i, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
runs AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY ALL),
cut AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
gone AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(x[2 * before + 1 : 2 * a], '' ORDER BY a) AS kept FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept || x[2 * last + 1 :], x))) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)"""
