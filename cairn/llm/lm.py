"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

One distributed pass cuts the texts into chunks and sends the distinct unigrams and bigrams of each chunk, by 64-bit hash
and with their counts in the training texts, to the segments of the hash. A segment quantises its counts to logarithmic
levels, puts every n-gram into its part of the filter once for each level up to its own (Talbot and Osborne 2007), reads
the level of each n-gram back by probing level after level until one is missing, and answers each chunk with a byte for
each n-gram. No task and no driver holds more than a segment of the filter, which has ``BITS`` bits for each entry at
every size.

A bigram's probability is interpolated with the unigram's by weights for the frequency of the context, fitted by EM with
each count left out of itself. A token's part of a score is a function of three levels (context, token, bigram), so the
counts of these triples over all training texts, a table of bounded size, are all that EM needs.

The base score needs exact counts; a segment answers them beside the levels of the unigrams.

Defined cases: null text is empty, and an empty text is the end token alone; texts are read whole; with no training
tokens every token is unknown; rows that repeat a doc_id are scored each; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, doc_mod, group_sums, prepare, split_words, starts_of

#: The end of a text; no word holds a space.
END = " end"
BASES = (math.sqrt(2.0), 2.0)
BITS, PROBES = 12, 6
SMOOTH = 0.1
BUCKETS = 32
#: Tokens of a chunk of texts.
GATHER = 3_000_000
_K = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * _K[0]) ^ (b * _K[1])
    h ^= h >> np.uint64(32)
    h *= _K[2]
    return h ^ (h >> np.uint64(29))


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct token hashes, the place of every token among them, tokens in each text (end included), contexts (-1: none)."""
    flat, counts = split_words(texts, lower=True)
    coded = flat.dictionary_encode()
    digest = xxhash.xxh64_intdigest
    kinds = np.array([digest(w.encode()) for w in coded.dictionary.to_pylist()] + [digest(END.encode())], np.uint64)
    n = counts + 1
    token = np.full(int(n.sum()), len(kinds) - 1, np.int64)
    token[np.arange(len(flat)) + np.repeat(np.arange(len(counts)), counts)] = coded.indices.to_numpy(zero_copy_only=False)
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[starts_of(n)] = -1
    return kinds, token, n, before


def bigrams(kinds: np.ndarray, token: np.ndarray, before: np.ndarray, shift: int) -> np.ndarray:
    """Keys of the bigrams: the segment's bits and 48 more, which is what travels."""
    start = np.append(kinds, np.uint64(1))  # the context at a text's start
    kept = (1 << 48) - 1 | ((1 << 64) - (1 << shift))
    return _mix(start[before], kinds[token]) & np.uint64(kept)


def levels(counts: np.ndarray, base: float) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(base) + 1e-9).astype(np.int64)


def level_count(level: np.ndarray, base: float) -> np.ndarray:
    """The count that a level stands for; 0 for none."""
    low = np.ceil(base ** np.maximum(level - 1, 0) - 1e-9)
    high = np.maximum(low, np.ceil(base**level - 1e-9) - 1)
    return np.where(level > 0, np.sqrt(low * high), 0.0)


def _bits(keys: np.ndarray, level: np.ndarray, kind: int, size: np.ndarray) -> Iterator[np.ndarray]:
    a = _mix(keys, (level * 2 + kind).astype(np.uint64))
    b = (_mix(a, keys) | np.uint64(1)) & np.uint64(0xFFFFFFFFFFFF)
    a &= np.uint64(0xFFFFFFFFFFFF)
    for i in range(PROBES):
        yield (a + np.uint64(i) * b) % size


def segment_bits(entries: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """One segment of the filter, a bool for each bit, from (keys, levels, kind of n-gram)."""
    total = int(sum(lv.sum() for _, lv, _ in entries))
    size = max(64, total * BITS)
    bits = np.zeros(size, bool)
    for keys, top, kind in entries:
        for j in range(1, int(top.max(initial=0)) + 1):
            own = keys[top >= j]
            for at in _bits(own, np.full(len(own), j), kind, np.uint64(size)):
                bits[at] = True
    return bits


def read_levels(bits: np.ndarray, keys: np.ndarray, kind: int, limit: int = 80) -> np.ndarray:
    """The levels that a segment of the filter gives for ``keys``."""
    out, open_ = np.zeros(len(keys), np.int64), np.arange(len(keys))
    for j in range(1, limit):
        own = keys[open_]
        hit = np.arange(len(own))
        for at in _bits(own, np.full(len(own), j), kind, np.uint64(len(bits))):
            hit = hit[bits[at[hit]]]
        open_ = open_[hit]
        out[open_] = j
        if not len(open_):
            break
    return out


def parts(code: np.ndarray, tokens: int, types: int, less: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (context, token, bigram) levels in one number: unigram probability, bigram ratio and the context's bucket."""
    context, one, two = level_count(code >> 14, BASES[0]), level_count(code >> 7 & 127, BASES[0]), level_count(code & 127, BASES[1])
    uni = (np.maximum(one - less, 0) + SMOOTH) / (tokens + SMOOTH * (types + 1))
    ratio = np.where(context > less, np.minimum(1.0, np.maximum(two - less, 0) / np.maximum(context - less, 1)), 0.0)
    return uni, ratio, np.minimum(BUCKETS - 1, np.log2(np.maximum(context, 1)).astype(np.int64))


def fit(code: np.ndarray, times: np.ndarray, tokens: int, types: int) -> np.ndarray:
    """Interpolation weights by EM over all training tokens, each left out of its own counts."""
    weights = np.full(BUCKETS, 0.1)
    uni, ratio, bucket = parts(code, tokens, types, less=1.0)
    total = np.bincount(bucket, weights=times, minlength=BUCKETS)
    for _ in range(20 if len(code) else 0):
        w = weights[bucket]
        share = times * w * ratio / (w * ratio + (1 - w) * uni)
        weights = np.clip((np.bincount(bucket, weights=share, minlength=BUCKETS) + 0.5) / (total + 10.0), 1e-4, 0.95)
    return weights


def _zip(a: np.ndarray) -> bytes:
    """The bytes of ``a`` by place, so that high ones compress."""
    return pa.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes(), codec="zstd", asbytes=True)


def _unzip(raw: bytes, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw, n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()


def _list(a: pa.Array) -> pa.Array:
    """One row that holds all of ``a``."""
    return pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)


def _before(token: np.ndarray, n: np.ndarray) -> np.ndarray:
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[starts_of(n)] = -1
    return before


def _trained(held_out: pa.Array, n: np.ndarray) -> np.ndarray:
    return np.repeat(pc.fill_null(pc.invert(held_out), False).to_numpy(zero_copy_only=False), n)


def _chunks(rows: DataFrame) -> DataFrame:
    """A row for each chunk of texts: doc_id, held_out, n of the texts, the distinct token hashes (most frequent first)
    and the place of every token among them."""
    names = ["chunk", "doc_id", "held_out", "n", "kinds", "token"]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, done = TaskContext.get().partitionId(), 0
        held: tuple[list, ...] = ([], [], [], [], [])

        def flush() -> pa.RecordBatch:
            ids, out, sizes, kinds, tokens = held
            n = np.concatenate(sizes)
            known, at = np.unique(np.concatenate(kinds), return_inverse=True)
            shifts = np.repeat(starts_of(np.array([len(k) for k in kinds])), [len(t) for t in tokens])
            token = at[np.concatenate(tokens) + shifts]
            order = np.argsort(-np.bincount(token, minlength=len(known)), kind="stable")
            rank = np.empty(len(known), "<i4")
            rank[order] = np.arange(len(known))
            row = [pa.array([(place << 24) + done]), _list(pa.concat_arrays(ids)), _list(pa.concat_arrays(out)), _list(pa.array(n, pa.int64())), pa.array([known[order].astype("<u8").tobytes()], pa.binary()), pa.array([_zip(rank[token])], pa.binary())]
            for x in held:
                x.clear()
            return pa.RecordBatch.from_arrays(row, names)

        for b in batches:
            if not b.num_rows:
                continue
            kinds, token, n, _ = hashed(b.column(2))
            for x, y in zip(held, (b.column(0), b.column(1), n, kinds, token), strict=True):
                x.append(y)
            if sum(map(len, held[4])) > GATHER:
                yield flush()
                done += 1
        if held[0]:
            yield flush()

    return rows.mapInArrow(gather, "chunk long, doc_id array<long>, held_out array<boolean>, n array<long>, kinds binary, token binary")


def _tokens(n: pa.Array, kinds: bytes, token: bytes) -> tuple[np.ndarray, ...]:
    """Of a chunk: tokens in each text, token hashes, the place of each token among them and that of its context."""
    sizes = n.to_numpy()
    at = _unzip(token, int(sizes.sum()), "<i4").astype(np.int64)
    return sizes, np.frombuffer(kinds, "<u8").astype(np.uint64), at, _before(at, sizes)


_ASKED = pa.schema([("chunk", pa.int64()), ("segment", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def _ask(chunks: DataFrame, segments: int) -> DataFrame:
    """The distinct n-grams of each chunk with their counts in training texts, by segment of the hash and in its order."""
    shift = 64 - (segments.bit_length() - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                n, kinds, token, before = _tokens(b.column(2).slice(i, 1).flatten(), b.column(3)[i].as_py(), b.column(4)[i].as_py())
                trained = _trained(b.column(1).slice(i, 1).flatten(), n)
                order = np.argsort(kinds)
                pairs, which = np.unique(bigrams(kinds, token, before, shift), return_inverse=True)
                out = []
                for kind, k, counts in ((0, kinds[order], np.bincount(token[trained], minlength=len(kinds))[order]), (1, pairs, np.bincount(which[trained], minlength=len(pairs)))):
                    edges = np.searchsorted((k >> np.uint64(shift)).astype(np.int64), np.arange(segments + 1))
                    # The segment is the top of a key: 6 bytes tell keys of one segment apart, 8 keep exact unigrams.
                    raw, counts = k.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : 8 if kind == 0 else 6], counts.astype("<u4")
                    for s in np.flatnonzero(np.diff(edges)).tolist():
                        own = slice(edges[s], edges[s + 1])
                        out.append({"chunk": b.column(0)[i].as_py(), "segment": s, "kind": kind, "keys": raw[own].T.tobytes(), "counts": counts[own].tobytes()})
                yield pa.RecordBatch.from_pylist(out, _ASKED)

    return chunks.select("chunk", "held_out", "n", "kinds", "token").mapInArrow(run, "chunk long, segment int, kind int, keys binary, counts binary")


_ANSWERED = pa.schema([("chunk", pa.int64()), ("segment", pa.int32()), ("kind", pa.int32()), ("size", pa.int32()), ("levels", pa.binary()), ("counts", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64())])


def _answer(asked: DataFrame, segments: int) -> DataFrame:
    """The levels that a segment's part of the filter gives for the n-grams asked, in their order, and exact counts of
    unigrams; tokens, types: those of the training texts, once for each segment."""

    def build(table: pa.Table) -> pa.Table:
        s = table["segment"][0].as_py()
        top = np.uint64(s << (16 - (segments.bit_length() - 1))) << np.uint64(48)
        chunk, kinds, keys, values = (table[c].to_pylist() for c in ("chunk", "kind", "keys", "counts"))
        entries, found = [], []
        for kind, width in ((0, 8), (1, 6)):
            rows = [i for i, k in enumerate(kinds) if k == kind]
            sizes = [len(keys[i]) // width for i in rows]
            full = np.zeros((sum(sizes), 8), np.uint8)
            for i, a, m in zip(rows, starts_of(np.array(sizes, np.int64)).tolist(), sizes, strict=True):
                full[a : a + m, :width] = np.frombuffer(keys[i], np.uint8).reshape(width, m).T
            own = full.view("<u8").ravel().astype(np.uint64) | (top if kind else np.uint64(0))
            n = np.frombuffer(b"".join(values[i] for i in rows), "<u4")
            known, at = np.unique(own, return_inverse=True)
            counts = np.bincount(at, weights=n, minlength=len(known)).astype(np.int64)
            kept = counts > 0  # held-out texts ask for n-grams without a count
            entries.append((known[kept], levels(counts[kept], BASES[kind]), kind))
            found.append((rows, sizes, known, at, counts))
        bits = segment_bits(entries)
        out = []
        for kind, (rows, sizes, known, at, counts) in enumerate(found):
            level = read_levels(bits, known, kind).astype(np.uint8)[at]
            for i, a, m in zip(rows, starts_of(np.array(sizes, np.int64)).tolist(), sizes, strict=True):
                exact = _zip(counts[at[a : a + m]].astype("<i8")) if kind == 0 else None
                out.append({"chunk": chunk[i], "segment": s, "kind": kind, "size": m, "levels": _zip(level[a : a + m]), "counts": exact, "tokens": 0, "types": 0})
        out[0] |= {"tokens": int(found[0][4].sum()), "types": int((found[0][4] > 0).sum())}
        return pa.Table.from_pylist(out, _ANSWERED)

    return asked.repartition(min(segments, 4096), "segment").groupBy("segment").applyInArrow(build, "chunk long, segment int, kind int, size int, levels binary, counts binary, tokens long, types long")


def _read(chunks: DataFrame, answered: DataFrame, segments: int, tokens: int, types: int) -> DataFrame:
    """A row for each chunk: doc_id, held_out, n_tokens, n_known and base_score of its texts, the levels of each token
    (context, token, bigram; codes), and how often each combination occurs in training texts."""
    shift, total = 64 - (segments.bit_length() - 1), tokens + SMOOTH * (types + 1)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "codes", "seen", "times"]

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        doc_id, held, n = (left[c].combine_chunks().flatten() for c in ("doc_id", "held_out", "n"))
        sizes, kinds, token, before = _tokens(n, left["kinds"][0].as_py(), left["token"][0].as_py())
        right = right.sort_by([("kind", "ascending"), ("segment", "ascending")])
        found: tuple[list, list, list] = ([], [], [])
        for kind, m, lv, c in zip(*(right[x].to_pylist() for x in ("kind", "size", "levels", "counts")), strict=True):
            found[kind].append(_unzip(lv, m, "u1"))
            if kind == 0:
                found[2].append(_unzip(c, m, "<i8"))
        order = np.argsort(kinds)
        one, exact = np.empty(len(kinds), np.int64), np.empty(len(kinds), np.int64)
        one[order], exact[order], two = np.concatenate(found[0]), np.concatenate(found[2]), np.concatenate(found[1]).astype(np.int64)
        _, place = np.unique(bigrams(kinds, token, before, shift), return_inverse=True)
        end = token[sizes[0] - 1]
        # As many starts as ends.
        code = (np.append(one, max(1, one[end]))[before] << 14) | (one[token] << 7) | two[place]
        seen = np.bincount(code[_trained(held, sizes)])
        kept = np.flatnonzero(seen)
        known, base = group_sums((exact > 0)[token], sizes).astype(np.int64), group_sums(np.log10((exact + SMOOTH) / total)[token], sizes)
        return pa.Table.from_arrays([*map(_list, (doc_id, held, n, pa.array(known), pa.array(base))), pa.array([_zip(code.astype("<i4"))], pa.binary()), _list(pa.array(kept.astype(np.int32))), _list(pa.array(seen[kept].astype(np.int64)))], names)

    both = chunks.groupBy("chunk").cogroup(answered.groupBy("chunk"))
    return both.applyInArrow(join, "doc_id array<long>, held_out array<boolean>, n_tokens array<long>, n_known array<long>, base_score array<double>, codes binary, seen array<int>, times array<long>")


def score(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    prepare(spark)
    held = held_out if held_out is not None else doc_mod(F.col("doc_id"), 10) == 0
    rows = docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), F.col("text").cast("string"))
    # A segment is the top bits of a hash; more input, more segments, at most 2^16.
    segments = 1 << max(6, min(16, (rows.rdd.getNumPartitions() * 4).bit_length()))
    chunks = cut(_chunks(rows))
    answered = cut(_answer(_ask(chunks, segments), segments))
    tokens, types = (int(x or 0) for x in answered.agg(F.sum("tokens"), F.sum("types")).first())
    read = cut(_read(chunks, answered.drop("tokens", "types"), segments, tokens, types))
    # At most 2^21 combinations of levels, a few thousand in practice.
    each = read.select(F.explode(F.arrays_zip("seen", "times")).alias("z")).groupBy("z.seen").agg(F.sum("z.times").alias("times")).orderBy("seen").toPandas()
    weights = fit(each["seen"].to_numpy(np.int64), each["times"].to_numpy(np.float64), tokens, types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                doc_id, held, n, known, base = (b.column(c).slice(i, 1).flatten() for c in range(5))
                sizes = n.to_numpy()
                codes, place = np.unique(_unzip(b.column(5)[i].as_py(), int(sizes.sum()), "<i4").astype(np.int64), return_inverse=True)
                uni, ratio, bucket = parts(codes, tokens, types)
                w = weights[bucket]
                logs = np.log10(np.minimum(1.0, w * ratio + (1 - w) * uni))
                yield pa.RecordBatch.from_arrays([doc_id, held, n, known, pa.array(np.full(len(n), tokens)), base, pa.array(group_sums(logs[place], sizes))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return read.drop("seen", "times").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
