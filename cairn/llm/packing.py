"""Best-fit packing of token sequences by a linear grouping scheme.

Documents become pieces of at most ``CAPACITY`` ids. All that packing needs of them is how many pieces have each length,
at most CAPACITY numbers, so the plan is made on the driver from that histogram, whatever the number of documents:

1. large lengths, in descending order, are cut into groups of equal cardinality and rounded up to the largest of a group;
2. the few sizes left make a cutting-stock problem; column generation (simplex and an unbounded knapsack) finds the
   configurations and how often to use each, rounded down;
3. actual pieces take the places of their group's size, so a configuration splits into runs of equal contents;
4. what is left, then the small pieces in descending order, go where they fit best, or into new sequences.

The plan is a table of runs (length, first rank, sequence, offset), bounded by the capacity and not by the data; it is
broadcast, and each piece finds its place by its rank among the pieces of its length.

Defined cases: null text is empty; an empty text is the closing id alone; only pieces longer than the capacity are cut;
repeated rows are packed each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare, salted_rank, split_words, spread, starts_of, text_bytes

CAPACITY = 2048
#: Lengths from CAPACITY / SMALL up are large.
SMALL = 3
GROUPS = 64
#: Parts that the pieces of a length are ranked in: at least, and pieces of a part where there are more.
SALTS, SALT_ROWS = 64, 50_000
#: Units whose ids a worker keeps; beyond it the store starts anew.
STORE = 400_000


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Merges:
    """The merges of a byte-pair vocabulary with word ends, applied to many pieces at once.

    Pieces of one length are a matrix of symbols; each round merges the best pair of every row (the lowest rank, the
    leftmost of equals), which is what the tokenizer does to one piece.
    """

    NONE = 1 << 30
    LONGEST = 40

    def __init__(self, model: dict):
        vocabulary, letters, end = model["vocab"], _byte_letters(), model["end_of_word_suffix"]
        self.inner = np.array([vocabulary[c] for c in letters], np.int64)
        self.last = np.array([vocabulary[c + end] for c in letters], np.int64)
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocabulary[a] << 20 | vocabulary[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], self.NONE)

    def apply(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after another, and how many each has. A piece has 1 to LONGEST bytes."""
        size = np.array([len(p) for p in pieces], np.int64)
        lengths, done = np.zeros(len(pieces), np.int64), []
        for m in np.unique(size).tolist():
            rows = np.flatnonzero(size == m)
            raw = np.frombuffer(b"".join([pieces[i] for i in rows]), np.uint8).reshape(-1, m)
            symbols = self.inner[raw]
            symbols[:, -1] = self.last[raw[:, -1]]
            rank = self.ranks(symbols[:, :-1], symbols[:, 1:])
            while len(rows):
                at = rank.argmin(1) if m > 1 else np.zeros(len(rows), np.int64)
                live = rank[np.arange(len(rows)), at] < self.NONE if m > 1 else np.zeros(len(rows), bool)
                if not live.all():
                    lengths[rows[~live]] = m
                    done.append((rows[~live], symbols[~live]))
                    rows, symbols, rank, at = rows[live], symbols[live], rank[live], at[live]
                if not len(rows):
                    break
                k = np.arange(len(rows))
                new = self.made[rank[k, at]]
                symbols = np.where(np.arange(m - 1) <= at[:, None], symbols[:, :-1], symbols[:, 1:])
                symbols[k, at] = new
                rank = np.where(np.arange(m - 2) < at[:, None], rank[:, :-1], rank[:, 1:])
                m -= 1
                left, right = k[at > 0], k[at < m - 1]
                rank[left, at[left] - 1] = self.ranks(symbols[left, at[left] - 1], new[left])
                rank[right, at[right]] = self.ranks(new[right], symbols[right, at[right] + 1])
        ids, starts = np.zeros(int(lengths.sum()), np.int64), starts_of(lengths)
        for rows, symbols in done:
            ids[starts[rows][:, None] + np.arange(symbols.shape[1])] = symbols
        return ids, lengths


#: Byte classes of plain words: letter (A-Z, a-z, and the two bytes of U+00C0 to U+00FF), digit, other; white space is 0.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 192), 0xC3]] = 1
_CLASS[48:58] = 2
#: Bytes that make a word other than plain: control characters, apostrophes (contractions), other letters than the above.
_ODD = np.zeros(256, bool)
_ODD[[*range(9), *range(14, 32), 39, 127, *range(192, 0xC3), *range(0xC4, 256)]] = True


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Units of all texts, one after another, how many each text has, and which units are plain.

    A plain word's units are its pieces in lower case: runs of letters, single digits, runs of others. Any other word is
    one unit as it stands.
    """
    data, offsets = text_bytes(texts)
    kind = _CLASS[data]
    inside = kind > 0
    before = np.zeros(len(data), np.uint8)
    before[1:] = kind[:-1]
    begins = offsets[:-1][np.diff(offsets) > 0]
    before[begins] = 0
    first = inside & (before == 0)
    odd = _ODD[data]
    after_c3 = np.zeros(len(data), bool)
    after_c3[1:] = data[:-1] == 0xC3
    continued = (data >= 128) & (data < 192)
    odd |= continued & ~after_c3
    odd |= after_c3 & ((data == 0x97) | (data == 0xB7))
    odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)
    word = np.cumsum(first)[inside] - 1
    is_odd = np.zeros(int(word[-1]) + 1 if len(word) else 0, bool)
    kept, kept_odd = data[inside], odd[inside]
    is_odd[word[kept_odd]] = True
    plain = ~is_odd[word]
    kind, before, starts = kind[inside], before[inside], first[inside]
    starts |= plain & ((kind != before) | (kind == 2))
    lower = kept + (plain & (kept >= 65) & (kept <= 90)).astype(np.uint8) * np.uint8(32)
    upper = plain & after_c3[inside] & (kept >= 0x80) & (kept <= 0x9E)
    lower[upper] += 32
    at = np.flatnonzero(starts)
    flat = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(kept)).astype(np.int64)), pa.py_buffer(lower))
    ends = np.cumsum(inside)
    bounds = np.concatenate([[0], ends])[offsets] if len(data) else np.zeros(len(offsets), np.int64)
    return flat, np.diff(np.searchsorted(at, bounds)), plain[at]


class UnitIds:
    """Ids of units. Pre-tokenisation never crosses white space, so a text's ids are those of its words' units.

    For a vocabulary file of the kind known here (NFC, white space and lower case, the split into letters, digits and
    others, byte-level pieces with word ends) the merges are applied to new plain units, many at once; other words, and
    pieces that are long, go to the tokenizer itself. With a file of another kind all words go there.
    """

    NORMAL = ("NFC", "Replace", "Lowercase")
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path).encode
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec["normalizer"] or {}).get("normalizers", [])
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        same = tuple(s["type"] for s in steps) == self.NORMAL and [s["type"] for s in split] == ["Split", "ByteLevel"]
        same = same and split[0]["pattern"].get("Regex") == self.SPLIT and spec["model"]["type"] == "BPE" and spec["model"].get("end_of_word_suffix")
        self.merges = Merges(spec["model"]) if same else None
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.starts, self.lengths, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def learn(self, names: list[str], plain: list[bool]) -> None:
        short = [n for n, p in zip(names, plain, strict=True) if p and len(n) <= Merges.LONGEST // 2]
        rest = [n for n, p in zip(names, plain, strict=True) if not p or len(n) > Merges.LONGEST // 2]
        ids, lengths = self.merges.apply([n.encode() for n in short]) if short else (np.empty(0, np.int64), np.empty(0, np.int64))
        each = [self.encode(n, add_special_tokens=False).ids for n in rest]
        lengths = np.concatenate([lengths, np.array([len(e) for e in each], np.int64)])
        ids = np.concatenate([ids, np.array([i for e in each for i in e], np.int64)]).astype(np.uint32)
        n = len(self.at)
        self.at.update(zip(short + rest, range(n, n + len(names)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + starts_of(lengths)])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, ids])

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each text with the closing id 0, one after another, and how many each has."""
        if self.merges is None:
            flat, counts = split_words(texts)
            plain = np.zeros(len(flat), bool)
        else:
            flat, counts, plain = units(texts)
        coded = flat.dictionary_encode()
        words = coded.dictionary.to_pylist()
        index = coded.indices.to_numpy(zero_copy_only=False)
        if len(self.at) + len(words) > STORE:
            self.clear()
        get = self.at.get
        at = np.array([get(w, -1) for w in words], np.int64)
        if (at < 0).any():
            new = np.flatnonzero(at < 0)
            is_plain = np.zeros(len(words), bool)
            is_plain[index] = plain
            self.learn([words[i] for i in new], is_plain[new].tolist())
            at[new] = [self.at[words[i]] for i in new]
        unit = at[index] if len(flat) else np.empty(0, np.int64)
        lengths = self.lengths[unit]
        ends = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(counts))]
        own = np.diff(ends)
        out = np.zeros(int(ends[-1]) + len(counts), np.uint32)
        body = np.arange(int(ends[-1])) + np.repeat(np.arange(len(counts)), own)
        out[body] = self.ids[spread(self.starts[unit], lengths)]
        return out, own + 1


@cache
def _units(path: str) -> UnitIds:
    return UnitIds(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _units(tokenizer)
        for b in batches:
            ids, n = known.texts(b.column(1))
            parts = -(-n // capacity)
            piece = spread(np.zeros(len(n), np.int64), parts)
            start = piece * capacity
            length = np.minimum(capacity, np.repeat(n, parts) - start)
            at = np.repeat(starts_of(n), parts) + start
            little = ids.astype("<u4")
            crc = [zlib.crc32(little[i:j]) for i, j in zip(at.tolist(), (at + length).tolist(), strict=True)]
            ids_col = b.column(0).take(pa.array(np.repeat(np.arange(len(n)), parts)))
            yield pa.RecordBatch.from_arrays([ids_col, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Configurations (how many of each size) and whole times to use each, covering no more than the demand."""
    m, size, need = len(sizes), np.array(sizes, np.int64), np.array(demand, np.float64)
    columns = [np.eye(m)[i] * (capacity // sizes[i]) for i in range(m)]
    basis, inverse = list(range(m)), np.diag([1.0 / (capacity // s) for s in sizes])
    x = inverse @ need
    for step in range(60 * m):
        if step % 100 == 99:
            inverse = np.linalg.inv(np.stack([columns[j] for j in basis], 1))
            x = inverse @ need
        price = np.ones(m) @ inverse
        # The most valuable filling, by dynamic programming over the room used.
        best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        worth = np.flatnonzero(price > 1e-12)
        own, value = size[worth], price[worth]
        for room in range(int(own.min(initial=capacity + 1)), capacity + 1):
            fits = own <= room
            total = np.where(fits, best[room - np.minimum(own, room)] + value, -1.0)
            k = int(total.argmax())
            if total[k] > best[room - 1] + 1e-15:
                best[room], took[room] = total[k], worth[k]
            else:
                best[room] = best[room - 1]
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(m), capacity
        while room > 0:
            if took[room] < 0:
                room -= 1
                continue
            column[took[room]] += 1
            room -= sizes[took[room]]
        direction = inverse @ column
        ratio = np.where(direction > 1e-10, np.maximum(x, 0) / np.where(direction > 1e-10, direction, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        columns.append(column)
        basis[out] = len(columns) - 1
        pivot = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, pivot)
        inverse[out] = pivot
        x = inverse @ need
    left, plan = np.array(demand, np.int64), []
    for j, times in sorted(zip(basis, x, strict=True), key=lambda p: -p[1]):
        column = np.rint(columns[j]).astype(np.int64)
        used = column > 0
        if not used.any():
            continue
        whole = min(int(np.floor(times + 1e-9)), int((left[used] // column[used]).min()))
        if whole > 0:
            left -= column * whole
            plan.append((column.tolist(), whole))
    return plan


class _Supply:
    """Pieces of one group, longest first, as [length, count] runs."""

    def __init__(self, runs: list[list[int]]):
        self.runs = runs[::-1]

    def take(self, n: int) -> list[tuple[int, int]]:
        out = []
        while n:
            run = self.runs[-1]
            k = min(n, run[1])
            out.append((run[0], k))
            run[1] -= k
            n -= k
            if not run[1]:
                self.runs.pop()
        return out


def _columns(slots: list[list[tuple[int, int]]]) -> Iterator[tuple[tuple[int, ...], int]]:
    """Runs of equal contents of sequences whose slots are filled by ``slots``, each a list of (length, count)."""
    at, left = [0] * len(slots), [s[0][1] for s in slots]
    while True:
        n = min(left)
        yield tuple(s[i][0] for s, i in zip(slots, at, strict=True)), n
        for k in range(len(slots)):
            left[k] -= n
            if not left[k]:
                at[k] += 1
                if at[k] == len(slots[k]):
                    return
                left[k] = slots[k][at[k]][1]


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence's pieces in order, how many such sequences). Takes every piece of the histogram."""
    left = {k: int(n) for k, n in histogram.items() if n}
    done: list[tuple[tuple[int, ...], int]] = []
    rooms: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]

    def put(contents: tuple[int, ...], n: int) -> None:
        room = capacity - sum(contents)
        if room == 0:
            done.append((contents, n))
        else:
            rooms[room].append((contents, n))

    if left.get(capacity):
        put((capacity,), left.pop(capacity))
    large = sorted((k for k in left if k * small >= capacity), reverse=True)
    total = sum(left[k] for k in large)
    if large:
        # Groups of equal cardinality; a length may stand in several groups.
        step, runs, filled = -(-total // groups), [[]], 0
        for k in large:
            n = left[k]
            while n:
                if filled == step:
                    runs.append([])
                    filled = 0
                part = min(n, step - filled)
                runs[-1].append([k, part])
                filled += part
                n -= part
        merged: dict[int, list[list[int]]] = {}
        for run in runs:
            merged.setdefault(run[0][0], []).extend(run)
        sizes = list(merged)
        supply = {s: _Supply([list(r) for r in merged[s]]) for s in sizes}
        for column, times in _configurations(sizes, [sum(n for _, n in merged[s]) for s in sizes], capacity):
            slots = [supply[s].take(times) for s, c in zip(sizes, column, strict=True) for _ in range(c)]
            for contents, n in _columns(slots):
                put(contents, n)
                for k in contents:
                    left[k] -= n
    for k in sorted((k for k in left if left[k]), reverse=True):
        n = left[k]
        while n:
            room = next((r for r in range(k, capacity + 1) if rooms[r]), None)
            if room is None:
                each = min(capacity // k, n)
                put((k,) * each, n // each)
                n -= n // each * each
                continue
            contents, have = rooms[room].pop()
            each = min(room // k, n)
            use = min(have, n // each)
            if use < have:
                rooms[room].append((contents, have - use))
            put((*contents, *(k,) * each), use)
            n -= use * each
    return done + [x for r in rooms for x in r]


def plan_runs(plan: list[tuple[tuple[int, ...], int]], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """length * 2^44 + first rank (sorted), sequence of that rank, offset in it."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for contents, n in plan:
        offset = 0
        for k in contents:
            rows.append((k << 44 | used[k], sequence, offset))
            used[k] += n
            offset += k
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    cutted = cut(pieces(docs, tokenizer, capacity))
    found = {r["length"]: r["n"] for r in cutted.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    shared = spark.sparkContext.broadcast(plan_runs(make_plan({k: int(n) for k, n in found.items()}, capacity), capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, seq, off = shared.value
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            at = np.searchsorted(first, (length << 44) + rank, side="right") - 1
            ids = seq[at] + rank - (first[at] & ((1 << 44) - 1)) if len(at) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(ids), pa.array(off[at])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # Equal lengths are ranked by parts of their hashes, more of them where there are more pieces. The written pieces keep
    # their places, so rows that agree in everything are told apart by these.
    salts = max(SALTS, math.ceil(sum(found.values()) / SALT_ROWS))
    salt = F.xxhash64("doc_id", "piece", "ids_crc32", F.spark_partition_id())
    ranked = salted_rank(cutted, ["length"], [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], salt, salts, "rank")
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
