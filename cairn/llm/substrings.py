"""Exact removal of repeated byte strings by prefix doubling.

Ranks of 1, 2, 4, ... bytes are hashes, each the pair of two ranks of half the length, so inside a text the doubling up
to 64 bytes needs no sort. Of the start positions of one text, those that share the least 32-byte rank in their window
(their anchor) form a run; anchors are chosen by content alone, so equal strings choose the same one, and the positions
that Spark must sort are the anchors, not all bytes:

1. Spark sorts (rank of the anchor, rank of the run's whole extent): unique ranks are done; within a pair all but the
   first run repeat an earlier one and are done as well. A task sends the first of each pair it has read, so a string
   that a third of all texts hold reaches the sort once for each task.
2. For ranks with several extents the first run of each goes on: its starts are cut at multiples of 8 before the anchor,
   and Spark sorts (rank of what the strings of a block share, rank of the block's extent), both pairs of 64-byte ranks.
3. For what still has several extents, the pair of 64-byte ranks at offsets 0 and 36 is the rank of a 100-byte string,
   past the threshold. Spark sorts these by (rank, a second rank from other hashes, document, position), and all but the
   first of each pair are marked. So strings count as equal if 128 bits of them are; runs, if their anchor's 64 bits and
   64 more of their whole extent are.

Marked strings are merged to spans and cut out of the texts. Documents are ordered by (doc_id, hash of the text); those
without a doc_id come before ids from 0 on, in the order of their texts' hashes.

Defined cases: null text is empty; texts shorter than the length lose nothing; matches stay inside a document; rows that
repeat a doc_id and a text are one document, and each such row gets its result; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, spread, starts_of, text_bytes

LENGTH = 100
ANCHOR = 32
#: Bytes of text whose ranks a task holds at once (some 60 times as much memory); longer texts are taken in parts.
AT_ONCE = 1 << 20
_M = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))
#: size of a run: starts in it, with 256 times the anchor's distance from the first; less than 0: that many marked starts.
_SCHEMA = "rank long, extent long, doc long, key long, at int, size int"
_NAMES = ["rank", "extent", "doc", "key", "at", "size"]
BLOCK = 8


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rank of two ranks."""
    h = a * _M[0]
    h ^= h >> np.uint64(31)
    h += b
    h *= _M[1]
    h ^= h >> np.uint64(29)
    return h


def ranks(data: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the 32 and of the 64 bytes from every position on (shorter by 31 and 63); other salts, other ranks."""
    h = (data.astype(np.uint64) + np.uint64(1 + 256 * salt)) * _M[2]
    h ^= h >> np.uint64(32)
    n, out = 1, []
    while n < 64:
        h = _pair(h[:-n], h[n:]) if len(h) > n else h[:0]
        n *= 2
        if n >= 32:
            out.append(h)
    return out[0], out[1]


def runs(data: np.ndarray, h32: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first start and last start of each run of starts 0 .. len(data) - length."""
    starts = len(data) - length + 1
    window = length - ANCHOR + 1
    # The least rank, the leftmost of equals: place in the low bits.
    key = (h32 & ~np.uint64((1 << 28) - 1)) | np.arange(len(h32), dtype=np.uint64)
    least, n = key, 1
    while 2 * n <= window:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    if n < window:
        least = np.minimum(least[: len(least) - (window - n)], least[window - n :])
    anchor = (least[:starts] & np.uint64((1 << 28) - 1)).astype(np.int64)
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    return anchor[first], first, np.append(first[1:], starts) - 1


def _parts(offsets: np.ndarray, length: int) -> Iterator[list[tuple[int, int, int]]]:
    """(document, first byte, last byte + 1) of parts of about AT_ONCE bytes; parts of one text overlap by length - 1."""
    own, size = [], 0
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        while b - a >= length:
            end = min(b, a + AT_ONCE + length - 1)
            own.append((i, a, end))
            size += end - a
            if size >= AT_ONCE:
                yield own
                own, size = [], 0
            a = end - length + 1 if end < b else b
    if own:
        yield own


def _batch(rank, extent, doc, key, at, size) -> pa.RecordBatch:
    cols = [rank.view(np.int64), extent.view(np.int64), doc.astype(np.int64), key.astype(np.int64), at.astype(np.int32), size.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], _NAMES)


def _marks(doc: np.ndarray, key: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """Rows of marked starts, those that touch merged; their rank deals them out by document."""
    order = np.lexsort((at, key, doc))
    doc, key, at, end = doc[order], key[order], at[order].astype(np.int64), (at + size)[order].astype(np.int64)
    other = np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))
    # The furthest end so far within a document: shift documents apart, then a running maximum.
    shift = np.cumsum(other) * np.int64(1 << 32)
    reach = np.maximum.accumulate(end + shift)
    first = np.flatnonzero(np.append(True, (at + shift)[1:] > reach[:-1]))
    last = np.append(first[1:], len(doc)) - 1
    doc, key, end, at = doc[first], key[first], (reach - shift)[last], at[first]
    return _batch(_pair(doc.astype(np.int64).view(np.uint64), key.astype(np.int64).view(np.uint64)), np.zeros(len(doc), np.uint64), doc, key, at, at - end)


def _send(found: list[tuple[np.ndarray, ...]], docs: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of (rank, extent, row, at, size) the first of each (rank, extent); the others are marked."""
    if not found:
        return
    rank, extent, of, at, size = (np.concatenate(x) for x in zip(*found, strict=True))
    doc, key = docs[of], keys[of]
    order = np.lexsort((at, key, doc, extent, rank))
    rank, extent, doc, key, at, size = (x[order] for x in (rank, extent, doc, key, at, size))
    new = np.append(True, (rank[1:] != rank[:-1]) | (extent[1:] != extent[:-1]))
    yield _batch(*(x[new] for x in (rank, extent, doc, key, at, size)))
    # A repeat of the same document and position (rows that repeat) is no earlier string.
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = ~new & ~((doc == doc[lead]) & (key == key[lead]) & (at == at[lead]))
    if later.any():
        yield _marks(doc[later], key[later], at[later], size[later] & 255)


def _first_runs(length: int):
    """Runs of every text by the rank of their anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, keys = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            data, offsets = text_bytes(b.column(2))
            found: list[tuple[np.ndarray, ...]] = []
            for part in _parts(offsets, length):
                joined = np.concatenate([data[a:e] for _, a, e in part])
                own_starts = starts_of(np.array([e - a for _, a, e in part], np.int64))
                h32, h64 = ranks(joined)
                for (i, a, e), at in zip(part, own_starts.tolist(), strict=True):
                    n = e - a
                    anchor, lo, hi = runs(joined[at : at + n], h32[at : at + n - ANCHOR + 1], length)
                    end = hi + length
                    middle = lo + (end - lo - 64) // 2
                    packed = (anchor - lo) << 8 | (hi - lo + 1)
                    extent = _pair(_pair(h64[at + lo], h64[at + middle]), _pair(h64[at + end - 64], packed.astype(np.uint64)))
                    found.append((h32[at + anchor], extent, np.full(len(lo), i), lo + (a - offsets[i]), packed))
            yield from _send(found, docs, keys)

    return run


def _groups(batches: Iterator[pa.RecordBatch], rows: int = 200_000) -> Iterator[list[np.ndarray]]:
    """Whole groups of equal rank of a partition sorted by rank, many at a time."""
    held: list[list[np.ndarray]] = []
    count = 0
    for b in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
        count += b.num_rows
        if count >= rows:
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            edge = int(np.searchsorted(whole[0], whole[0][-1]))
            if edge:
                yield [c[:edge] for c in whole]
            held = [[c[edge:] for c in whole]]
            count = len(held[0][0])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _by_extent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marked rows, and the first run of each extent whose rank has several."""
    for g in _groups(batches):
        passed = g[5] < 0
        if passed.any():
            yield _batch(*(c[passed] for c in g))
        rank, extent, doc, key, at, size = (c[~passed] for c in g)
        if not len(rank):
            continue
        new_rank = np.append(True, rank[1:] != rank[:-1])
        new = new_rank | np.append(True, extent[1:] != extent[:-1])
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = ~new & ~((doc == doc[lead]) & (key == key[lead]) & (at == at[lead]))
        if later.any():
            yield _marks(doc[later], key[later], at[later], size[later] & 255)
        extents = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_rank))[np.cumsum(new_rank) - 1]
        more = new & (extents > 1)
        if more.any():
            yield _batch(*(c[more] for c in (rank, extent, doc, key, at, size)))


def _blocks(at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start, starts and place of what they share, of each block of the runs."""
    ahead, n = size >> 8, size & 255
    low = ahead - n + 1  # distance of the anchor from the last start
    first = low // BLOCK
    count = ahead // BLOCK - first + 1
    block = spread(first, count)
    anchor, ahead, low = (np.repeat(x, count) for x in (at + ahead, ahead, low))
    far, near = np.minimum(ahead, block * BLOCK + BLOCK - 1), np.maximum(low, block * BLOCK)
    return anchor - far, (anchor - block * BLOCK - (anchor - far)) << 8 | (far - near + 1), anchor - block * BLOCK


def _next(length: int, last: bool):
    """From a text and the rows about it: the next ranks of its open runs, and its marks merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, keys = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            data, offsets = text_bytes(b.column(2))
            lists = b.column(3)
            counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            at_all, size_all = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            row = np.repeat(np.arange(len(docs)), counts)
            marked = size_all < 0
            if marked.any():
                yield _marks(docs[row[marked]], keys[row[marked]], at_all[marked], -size_all[marked])
            found: list[tuple[np.ndarray, ...]] = []
            for i in np.unique(row[~marked]).tolist():
                own = ~marked & (row == i) if len(docs) < 2 else slice(*np.searchsorted(row, [i, i + 1]))
                at, size = at_all[own], size_all[own]
                at, size = at[size >= 0], size[size >= 0]
                if last:
                    first = np.unique(spread(at, size & 255))
                    size = np.ones(len(first), np.int64)
                    shared = first
                else:
                    first, size, shared = _blocks(at, size)
                text = data[offsets[i] : offsets[i + 1]]
                for begin in range(0, len(text), AT_ONCE):
                    here = (first >= begin) & (first < begin + AT_ONCE)
                    if not here.any():
                        continue
                    part = text[begin : begin + AT_ONCE + 2 * length]
                    _, h64 = ranks(part)
                    _, other = ranks(part, 1) if last else (h64, h64)
                    p, core, n = first[here] - begin, shared[here] - begin, size[here]
                    whole = length if last else length - BLOCK + 1
                    rank = _pair(h64[core], h64[core + whole - 64])
                    extent = _pair(other[p], other[p + length - 64]) if last else _pair(_pair(h64[p], h64[p + (n & 255) - 1 + length - 64]), n.astype(np.uint64))
                    found.append((rank, extent, np.full(len(p), i), first[here], n))
            yield from _send(found, docs, keys)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, text, n_bytes, n_removed, n_spans, kept (bytes), spans (first byte, bytes) of every document."""
    if not 96 <= length <= 128:
        raise ValueError("this operator is built for lengths of 96 to 128 bytes")
    spark = docs.sparkSession
    prepare(spark)
    # The texts of one doc_id are told apart by 64 bits of their hash, those without any id by 63 more of another.
    text, doc_id = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    key = F.xxhash64(text).bitwiseAND(F.lit(2**63 - 1))
    none = F.xxhash64(F.lit(7), text).bitwiseOR(F.lit(-(2**63)))
    rows = docs.select(F.coalesce(doc_id, none).alias("doc"), F.when(doc_id.isNull(), -1 - key).otherwise(key).alias("key"), F.col("text").cast("string").alias("text"), doc_id.alias("doc_id"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def sort(sent: DataFrame, last: bool = False) -> DataFrame:
        ordered = sent.repartition(n, "rank").sortWithinPartitions("rank", "extent", "doc", "key", "at")
        left = ordered.mapInArrow(_by_extent, _SCHEMA)
        left = left.where("size < 0") if last else left
        return left.groupBy("doc", "key").agg(F.collect_list(F.struct("at", "size")).alias("runs"))

    # The three joins below read one exchange of the texts.
    step = sort(rows.select("doc", "key", "text").where(F.octet_length("text") >= length).mapInArrow(_first_runs(length), _SCHEMA))
    for last in (False, True):
        step = sort(rows.join(step, ["doc", "key"]).select("doc", "key", "text", "runs", "doc_id").mapInArrow(_next(length, last), _SCHEMA), last)
    marked = step.withColumnRenamed("runs", "spans")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            out: list[list] = [[], [], [], [], []]
            for i, spans in enumerate(b.column(2).to_pylist()):
                text = data[offsets[i] : offsets[i + 1]]
                gone = np.zeros(len(text) + 1, np.int64)
                for s in spans or ():
                    gone[s["at"]] += 1
                    gone[s["at"] - s["size"] + length - 1] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                for x, v in zip(out, (len(text), int(gone.sum()), len(edges) // 2, text[~gone].tobytes(), [{"at": int(p), "size": int(q - p)} for p, q in edges.reshape(-1, 2)]), strict=True):
                    x.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("at", pa.int64()), ("size", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, k) for x, k in zip(out, kinds, strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    joined = rows.join(marked, ["doc", "key"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<at: long, size: long>>")

