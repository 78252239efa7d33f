"""SimHash near-duplicates: fingerprints of word shingles, links by BK-trees, components by alternating stars.

``near_duplicates`` links 64-bit fingerprints within ``RADIUS`` = 2 bits, exactly. Such fingerprints agree on at least two of
four blocks of their bits, so the six pairs of blocks deal the distinct fingerprints to shards that no link can leave
unseen. A shard above ``SHARD`` members is dealt again in the same way by the bits that its members don't share, up to
twice, after which it has at most 256. Each shard is a BK-tree: a node's children are keyed by their integer Hamming
distance to it, and a search follows only edges within the radius of its own distance. A shard's tree is built where its
members are (trees of all shards would not have a bounded size to broadcast), and a member is linked to the components
that it touches only, never to each partner, so a shard emits fewer links than members.

``similar_documents`` is for texts whose shingle sets are alike (a Jaccard similarity of 0.8 or more of five-word shingles).
They differ in about 15 % of a fingerprint's bits, beyond any exact dealing by blocks, and by too much chance in 64 of them:
fingerprints have 256 bits here, and shards are bands of ``ROWS`` min-hashes, of which such texts share one with a
probability of 0.99999. The links that trees find are held against the texts' shingle sets; in small shards a member has
some links more than join groups, for those that fail, and elsewhere its nearest in each group. In a shard above ``SHARD`` members each part of it is a tree; of members within half the radius of
a leader only the leader goes on, and the leaders are dealt again with more min-hashes. So passages that many texts share,
and large groups of near copies, end in small shards.

Defined cases: null and wordless texts have fingerprint zero and link like any other; fewer words than a shingle has: one
shingle of them all; rows that repeat a doc_id stay; a null doc_id links like any other but names no component (a
component of null ids only has a null component_id); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted, prepare, split_words, spread, starts_of
from .graph import components

SHINGLE = 3
RADIUS = 2
SHARD = 1024
#: Shingles whose bits are counted at once.
_BITS_AT_ONCE = 1 << 16
#: Words of a shingle and least similarity of similar documents; bits of their fingerprints / 64, and what those of two may
#: differ by: at this similarity 39 bits on average, and one pair in 50 by more than the radius.
WORDS, SIMILARITY, LONGS, WIDE_RADIUS = 5, 0.8, 4, 50
#: Links of a member to its nearest ones, besides those that join groups, in shards of so many members.
SPARE, FEW = 4, 16
#: Parts of a text's hash by which texts are left out before they are joined; the parts that occur are broadcast.
SLOTS = 1 << 20
#: Bands of min-hashes, min-hashes of a band, and bands that a large shard's leaders are dealt by again, so often.
BANDS, ROWS, AGAIN, DEPTH = 16, 3, 6, 4
_M = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))


def _fingerprint(joined: bytes, first: np.ndarray, last: np.ndarray) -> int:
    """``joined``: the words with single spaces; first, last: where each shingle begins and ends."""
    digest, n = xxhash.xxh64_intdigest, len(first)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _BITS_AT_ONCE):
        s, e = first[at : at + _BITS_AT_ONCE].tolist(), last[at : at + _BITS_AT_ONCE].tolist()
        h = np.array([digest(joined[i:j], 42) for i, j in zip(s, e, strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * ones > n)))


def fingerprints(docs: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp long (the 64 bits) and ``columns`` of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, counts = split_words(b.column(1), lower=True)
            sizes = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
            out = np.zeros(len(counts), np.uint64)
            for i, (at, n) in enumerate(zip(starts_of(counts), counts, strict=True)):
                if not n:
                    continue
                joined = " ".join(flat.slice(at, n).to_pylist()).encode()
                ends = np.cumsum(sizes[at : at + n] + 1) - 1
                begins = ends - sizes[at : at + n]
                k = min(SHINGLE, n)
                out[i] = _fingerprint(joined, begins[: n - k + 1], ends[k - 1 :])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out.view(np.int64)), *b.columns[2:]], ["doc_id", "fp", *columns])

    prepare(docs.sparkSession)
    schema = ", ".join(["doc_id long", "fp long", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *columns).mapInArrow(run, schema)


class BKTree:
    """Children are keyed by their Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, value: int, radius: int) -> list[tuple[int, int]]:
        """(distance, value) of the nodes within ``radius`` of ``value``."""
        found, values, children = [], self.values, self.children
        todo = [0] if values else []
        while todo:
            node = todo.pop()
            d = (values[node] ^ value).bit_count()
            if d <= radius:
                found.append((d, values[node]))
            todo += [c for k, c in children[node].items() if d - radius <= k <= d + radius]
        return found

    def add(self, value: int) -> None:
        node, nxt = None, 0 if self.values else None
        while nxt is not None:
            node, d = nxt, (self.values[nxt] ^ value).bit_count()
            nxt = self.children[node].get(d)
        if node is not None:
            self.children[node][d] = len(self.values)
        self.values.append(value)
        self.children.append({})


def shard_links(members: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that join the members of one shard which belong together; fewer than members."""
    return tree_links(members, radius, False)[0]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[int]]:
    """Members of each key of two or more in a partition sorted by (key columns, fp); fp is the last column."""
    kept: list[np.ndarray] | None = None
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if kept is not None:
            cols = [np.concatenate([x, y]) for x, y in zip(kept, cols, strict=True)]
        if not len(cols[0]):
            continue
        new = np.any([c[1:] != c[:-1] for c in cols[:-1]], axis=0)
        edges = np.flatnonzero(new) + 1
        bounds = np.concatenate([[0], edges, [len(cols[0])]])
        for i in np.flatnonzero(np.diff(bounds[:-1]) > 1):
            yield cols[-1][bounds[i] : bounds[i + 1]].view(np.uint64).tolist()
        kept = [c[bounds[-2] :] for c in cols]
    if kept is not None and len(kept[0]) > 1:
        yield kept[-1].view(np.uint64).tolist()


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([_signed(a) for a, _ in links], pa.int64()), pa.array([_signed(b) for _, b in links], pa.int64())], ["a", "b"])


def _finer(mask: int) -> list[int]:
    """Masks of ``mask`` and any two of four blocks of the other bits."""
    free = [i for i in range(64) if not mask >> i & 1]
    n = len(free) // 4
    blocks = [sum(1 << i for i in free[k * n : (k + 1) * n]) for k in range(4)]
    return [mask | blocks[a] | blocks[b] for a in range(4) for b in range(a + 1, 4)]


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: list[tuple[int, int]] = []
    for members in _runs(batches):
        found += shard_links(members)
        if len(found) > 50_000:
            yield _pairs(found)
            found = []
    yield _pairs(found)


def links(distinct: DataFrame, shard: int = SHARD) -> DataFrame:
    """a, b: links between the distinct fingerprints (column fp) whose components are those of all links."""
    spark = distinct.sparkSession
    prepare(spark)
    masks, found = _finer(0), None
    dealt = distinct.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    for level in range(3):
        dealt = dealt.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("bits"), "fp")
        sizes = dealt.groupBy("mask", "bits").agg(F.count("*").alias("n")).where("n > 1").withColumn("big", (F.col("n") > shard) if level < 2 else F.lit(False)).drop("n")
        dealt = cut(dealt.join(sizes, ["mask", "bits"]).select("mask", "bits", "fp", "big"))
        small = dealt.where("not big").select("mask", "bits", "fp").repartition("mask", "bits").sortWithinPartitions("mask", "bits", "fp").mapInArrow(_trees, "a long, b long")
        found = small if found is None else found.unionByName(small)
        large = dealt.where("big").select("mask", "fp")
        if level == 2 or large.isEmpty():
            return found
        finer = spark.createDataFrame([(_signed(m), _signed(x)) for m in masks for x in _finer(m)], "mask long, finer long")
        masks = [x for m in masks for x in _finer(m)]
        dealt = large.join(F.broadcast(finer), "mask").select("fp", F.col("finer").alias("mask"))  # 36 or 216 rows
    raise AssertionError


def near_duplicates(docs: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links), component (a number
    of its own for each, those without any id too) and ``columns``."""
    prints = cut(fingerprints(docs, columns))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")))
    joined = components(links(distinct.select("fp")), "a", "b")  # node, root: of fingerprints with a link
    at = cut(distinct.join(joined, distinct["fp"] == joined["node"], "left").select("fp", "first", "rows", F.coalesce("root", "fp").alias("root")))
    least = at.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("prints"))
    named = join_counted(at, least, "root", "prints", at.count()).select("fp", "component_id", F.col("root").alias("component"), "rows")
    return join_counted(prints, cut(named), "fp", "rows", prints.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component", *columns)


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    out = (h ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * _M[1]
    out ^= out >> np.uint64(29)
    out *= _M[2]
    return out ^ (out >> np.uint64(32))


def shingle_hashes(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, in order of the hash, and how many each text has."""
    flat, counts = split_words(texts, lower=True)
    coded = flat.dictionary_encode()
    known = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    word = known[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.empty(0, np.uint64)
    ends = np.repeat(np.cumsum(counts), counts)
    h, at = word * _M[0], np.arange(len(word))
    for j in range(1, size):
        inside = np.flatnonzero(at + j < ends)
        joined = h[inside] ^ (h[inside] >> np.uint64(31))
        h[inside] = (joined + word[inside + j]) * _M[0]
    n = np.where(counts > 0, np.maximum(1, counts - size + 1), 0)
    h, of = h[spread(starts_of(counts), n)], np.repeat(np.arange(len(counts)), n)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1]))[: len(h)]
    return h[new], np.bincount(of[new], minlength=len(counts))


def signatures(texts: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Wide fingerprints (texts, LONGS) and min-hashes (texts, BANDS x ROWS); zeros for a text without words."""
    h, n = shingle_hashes(texts, size)
    full, of = np.flatnonzero(n > 0), np.repeat(np.arange(len(n)), n)
    ones = np.zeros((len(n), 64 * LONGS), np.int32)
    for a in range(0, len(h), _BITS_AT_ONCE):
        part, own = h[a : a + _BITS_AT_ONCE], of[a : a + _BITS_AT_ONCE]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        for k in range(LONGS):
            bits = np.unpackbits(_mix(part, k + 1).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[own[first], 64 * k : 64 * k + 64] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    prints = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view(np.uint64)
    least = np.zeros((len(n), BANDS * ROWS), np.uint64)
    if len(h):
        starts = starts_of(n)[full]
        for k in range(BANDS * ROWS):
            least[full, k] = np.minimum.reduceat(_mix(h, 100 + k), starts)
    return prints, least


def _band(least: np.ndarray, band: int, level: int) -> np.ndarray:
    key = np.full(len(least), band + 1000 * level, np.uint64)
    for k in range(ROWS):
        key = _mix(key ^ least[:, band * ROWS + k], k + 1)
    return key.view(np.int64)


def tree_links(members: list[int], radius: int, leaders: bool, spare: int = 0) -> tuple[list[tuple[int, int]], list[int]]:
    """Links that join the members of one shard, from each to the nearest of each group that it touches; ``spare`` more to
    the nearest of all, where a link may be refuted later. With ``leaders`` members within half the radius of one are no
    part of the tree, and the others are returned."""
    tree, root, out = BKTree(), {}, []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for value in members:
        near = sorted(tree.near(value, radius))
        root[value] = value
        for k, (_, j) in enumerate(near):
            a, b = find(value), find(j)
            if a != b or k < spare:
                root[max(a, b)] = min(a, b)
                out.append((j, value))
        if not (leaders and near and near[0][0] <= radius // 2):
            tree.add(value)
    return out, tree.values


def _deal(large: bool):
    """Links of the shards of a partition sorted by (key, part), and with ``large`` the leaders of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members = None, []

        def done() -> pa.RecordBatch:
            found, leaders = tree_links(members, WIDE_RADIUS, large, SPARE if len(members) <= FEW else 0)
            raw = lambda values: pa.array([v.to_bytes(8 * LONGS, "little") for v in values], pa.binary())
            left, right = [a for a, _ in found] + (leaders if large else []), [b for _, b in found]
            return pa.RecordBatch.from_arrays([raw(left), pa.concat_arrays([raw(right), pa.nulls(len(left) - len(right), pa.binary())]), pa.array([now[0]] * len(left), pa.int64())], ["a", "b", "key"])

        for b in batches:
            for key, part, node in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now != (key, part):
                    if len(members) > 1 or (large and members):
                        yield done()
                    now, members = (key, part), []
                members.append(int.from_bytes(node, "little"))
        if len(members) > 1 or (large and members):
            yield done()

    return run


def similar_links(signed: DataFrame) -> DataFrame:
    """a, b: links between nodes (wide fingerprints); ``signed``: node, least (min-hashes as bytes), each node once."""

    def bands(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                least = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint64).reshape(-1, BANDS * ROWS)
                base = b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
                for k in range(BANDS if not level else AGAIN):
                    band = k if not level else (level * 7 + k * 5) % BANDS
                    key = _band(least, band, level)
                    key = key if not level else _mix(base ^ key.view(np.uint64), level).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0)], ["key", "node"])

        return run

    found, open_ = None, signed.where(F.length("least") > 0).select("node", "least", F.lit(0).cast("long").alias("key"))
    for level in range(DEPTH):
        dealt = open_.select("node", "least", "key").mapInArrow(bands(level), "key long, node binary")
        dealt = dealt.distinct() if level else dealt
        sizes = dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        dealt = cut(dealt.join(sizes, "key").select("key", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / SHARD)).alias("part"), "node", (F.col("n") > SHARD).alias("big")))
        parts = lambda df: df.select("key", "part", "node").repartition("key", "part").sortWithinPartitions("key", "part", "node")
        schema = "a binary, b binary, key long"
        small = parts(dealt.where("not big")).mapInArrow(_deal(False), schema).select("a", "b")
        found = small if found is None else found.unionByName(small)
        large = dealt.where("big")
        if large.isEmpty():
            break
        led = cut(parts(large).mapInArrow(_deal(True), schema))
        found = found.unionByName(led.where("b IS NOT NULL").select("a", "b"))
        open_ = led.where("b IS NULL").select(F.col("a").alias("node"), "key").join(signed, "node")
    return found


def verified(links: DataFrame, each: DataFrame, docs: DataFrame) -> DataFrame:
    """Those ``links`` (a, b) whose shingle sets have a Jaccard similarity of SIMILARITY or more. ``each``: node, h, g of one
    text of every node; ``docs``: text, h, g. Only the texts of nodes with a link are read."""
    asked = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    which = each.join(asked, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, n = shingle_hashes(b.column(1), WORDS)
            edges = pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(edges, pa.array(hashes.view(np.int64)))], ["node", "shingles"])

    which = cut(which)
    slot = lambda c: F.pmod(F.col(c), F.lit(SLOTS))
    some = docs.join(F.broadcast(which.select(slot("h").alias("_slot")).distinct()), slot("h") == F.col("_slot"), "left_semi")  # SLOTS rows at most
    # Copies of a text are many, but a task sends one of them.
    texts = some.join(which, ["h", "g"]).groupBy("node").agg(F.min("text").alias("text"))
    sets = cut(texts.select("node", "text").mapInArrow(run, "node binary, shingles array<long>"))
    both = links.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= SIMILARITY * (F.size("x") + F.size("y") - shared)).select("a", "b")


def similar_documents(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``columns`` of each document and component (bytes): the least wide fingerprint reachable over links."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints, least = signatures(b.column(0))
            none = ~least.any(axis=1)
            raw = [b"" if x else row.tobytes() for x, row in zip(none, least, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes() for p in prints], pa.binary()), pa.array(raw, pa.binary()), *b.columns[1:]], ["node", "least", *names])

    # Which text: 128 bits of it. The names of ``columns`` are given back at the end.
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    names = ["h", "g", *(f"c{i}" for i in range(len(columns)))]
    keyed = docs.select(text.alias("text"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    schema = ", ".join(["node binary, least binary", *(f"{c} {keyed.schema[c].dataType.simpleString()}" for c in names)])
    signed = cut(keyed.mapInArrow(run, schema))
    each = cut(signed.groupBy("node").agg(F.min("least").alias("least"), F.count("*").alias("rows"), F.min(F.struct("h", "g")).alias("k")))
    found = cut(similar_links(each.select("node", "least")).distinct())
    links = verified(found, each.select("node", "k.*"), keyed.select("text", "h", "g"))
    joined = components(links, "a", "b").select(F.col("node").alias("_node"), F.col("root").alias("component"))
    named = each.select("node", "rows").join(joined, F.col("node") == F.col("_node"), "left").select("node", "rows", F.coalesce("component", "node").alias("component"))
    out = join_counted(signed.drop("least", "h", "g"), cut(named), "node", "rows", signed.count())
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], "component")
