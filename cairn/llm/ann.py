"""Approximate nearest neighbours by learned partitions.

A bounded sample gives a neighbour graph; its balanced partition (equal parts, few edges cut) is learned by a small
classifier, which then files every row under its most probable part and sends each query to the several most probable
ones, enough for the recall asked for on the sample. Within a part, candidates are ranked by exact distances. Parts are
cut into slices and their queries into blocks by measured counts, so a part with a third of all rows is dealt out.

Defined cases: vectors that are null, empty, zero, of another dimension than the sample's most frequent one, or hold null
or non-finite components take no part; a query is compared with rows of other ids; of query rows that repeat an id the
least vector counts, candidate rows that repeat an id count each; ties go to the smaller id; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, prepare
from .topk import Held, best, matrices, tile_search, valid

#: Rows that the graph and the classifier are fitted on, at most.
SAMPLE = 8192
NEIGHBOURS = 10
#: Parts at least and at most (64 sample rows each), and rows of a part in between.
PARTS, MOST_PARTS, PART_ROWS = 16, 128, 65_536
#: Parts for rows of other dimensions than the model's, by dimension.
OTHERS = 16
HIDDEN = 96
EPOCHS = 12
#: Share of a sample row's neighbours that must lie in the parts its query goes to.
RECALL = 0.95
#: Rows of a tile, about.
TILE_ROWS = 65_536


@dataclass
class Model:
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row."""
    squares = (x**2).sum(1)
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 512):
        d = squares[None, :] - 2 * (x[at : at + 512] @ x.T)
        d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
        out[at : at + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 0.05) -> np.ndarray:
    """Parts of about equal size with few graph edges between them: halving along principal axes, then moves by votes."""
    part = np.zeros(len(x), np.int64)
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        own = groups.pop(0)
        _, _, axes = np.linalg.svd(x[own] - x[own].mean(0), full_matrices=False)
        order = own[np.argsort(x[own] @ axes[0], kind="stable")]
        groups += [order[: len(order) // 2], order[len(order) // 2 :]]
    for p, own in enumerate(groups):
        part[own] = p
    n, k = graph.shape
    a = np.concatenate([np.repeat(np.arange(n), k), graph.ravel()])
    b = np.concatenate([graph.ravel(), np.repeat(np.arange(n), k)])
    most = math.ceil((1 + slack) * n / parts)
    for _ in range(rounds):
        votes = np.bincount(a * parts + part[b], minlength=n * parts).reshape(n, parts)
        goal = votes.argmax(1)
        gain = votes[np.arange(n), goal] - votes[np.arange(n), part]
        size, moved = np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[goal[i]] < most:
                size[part[i]] -= 1
                size[goal[i]] += 1
                part[i] = goal[i]
                moved += 1
        if moved < n / 500:
            break
    return part


def fit(x: np.ndarray, parts: int, seed: int = 5) -> Model:
    """x: distinct sample vectors."""
    rng, d = np.random.default_rng(seed), x.shape[1]
    k = min(NEIGHBOURS, len(x) - 1)
    parts = max(1, min(parts, len(x) // 64))
    model = Model(rng.normal(0, math.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, math.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts), 1)
    if parts == 1:
        return model
    graph = neighbour_graph(x, k)
    part = balanced_partition(x, graph, parts)
    # A row's label: the parts of its neighbours and its own.
    goal = np.zeros((len(x), parts))
    np.add.at(goal, (np.repeat(np.arange(len(x)), k), part[graph].ravel()), 0.5 / k)
    goal[np.arange(len(x)), part] += 0.5
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    names = ("w1", "b1", "w2", "b2")
    mean, square, step = {n: 0.0 for n in names}, {n: 0.0 for n in names}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 128):
            own = order[at : at + 128]
            h = np.maximum(unit[own] @ model.w1 + model.b1, 0)
            back = (model.probabilities(x[own]) - goal[own]) / len(own)
            below = (back @ model.w2.T) * (h > 0)
            step += 1
            for n, g in zip(names, (unit[own].T @ below, below.sum(0), h.T @ back, back.sum(0)), strict=True):
                mean[n] = 0.9 * mean[n] + 0.1 * g
                square[n] = 0.999 * square[n] + 0.001 * g**2
                setattr(model, n, getattr(model, n) - 3e-3 * (mean[n] / (1 - 0.9**step)) / (np.sqrt(square[n] / (1 - 0.999**step)) + 1e-8))
    chance = model.probabilities(x)
    filed, ranked = chance.argmax(1), np.argsort(-chance, axis=1, kind="stable")
    place = np.empty_like(ranked)
    place[np.arange(len(x))[:, None], ranked] = np.arange(parts)
    reached = np.sort(place[np.arange(len(x))[:, None], filed[graph]].ravel())
    model.probes = int(reached[min(len(reached) - 1, math.ceil(RECALL * len(reached)) - 1)]) + 1
    return model


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance on the original vectors)."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.where(valid(F.col(vector_col), nonzero=True) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    drawn = rows.select("id", "v").orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).collect()
    sizes = [len(r["v"]) for r in drawn]
    if not drawn:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = max(set(sizes), key=lambda s: (sizes.count(s), -s))
    sample = np.unique(np.array([r["v"] for r in drawn if len(r["v"]) == d], np.float64), axis=0)
    model = fit(sample, max(PARTS, min(MOST_PARTS, 1 << (math.ceil(rows.count() / PART_ROWS) - 1).bit_length())))
    parts, sent = len(model.b2), spark.sparkContext.broadcast(model)

    def file(batches: Iterator[pa.RecordBatch], probes: int) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            part = np.repeat((parts + size % OTHERS)[:, None], probes, axis=1)
            part[:, 1:] = -1
            own = np.flatnonzero(size == d)
            for _, x in matrices(b.column(0).take(pa.array(own)), b.column(1).take(pa.array(own))):
                part[own] = np.argsort(-sent.value.probabilities(x), axis=1, kind="stable")[:, :probes]
            for j in range(probes):
                used = pa.array(np.flatnonzero(part[:, j] >= 0))
                yield pa.RecordBatch.from_arrays([b.column(0).take(used), b.column(1).take(used), pa.array(part[:, j].astype(np.int32)).take(used)], ["id", "v", "part"])

    schema = f"id long, v {rows.schema['v'].dataType.simpleString()}, part int"
    filed = cut(rows.select("id", "v").mapInArrow(lambda b: file(b, 1), schema))
    asked = rows.where("is_query").groupBy("id").agg(F.min("v").alias("v"))
    asked = asked.select("id", "v").mapInArrow(lambda b: file(b, min(model.probes, parts)), schema)
    counts = {r["part"]: r["count"] for r in filed.groupBy("part").count().collect()}  # a row for each part
    # A tile holds TILE_ROWS rows, or fewer where that leaves cores idle.
    wanted = max(1, min(TILE_ROWS, math.ceil(sum(counts.values()) / (4 * spark.sparkContext.defaultParallelism))))
    tiles = np.array([max(1, math.ceil(counts.get(p, 0) / wanted)) for p in range(parts + OTHERS)])
    first = np.cumsum(tiles) - tiles
    of = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("part") + 1)
    dealt = filed.withColumn("tile", of(first) + F.pmod(F.xxhash64("id", "v"), of(tiles)).cast("int"))
    each = asked.withColumn("tile", F.explode(F.sequence(of(first), of(first) + of(tiles) - 1)))

    def ready(held: Held) -> dict:
        joined = {n: (np.concatenate([p[0] for p in own]), np.concatenate([p[1] for p in own])) for n, own in held.items()}
        return {n: (ids, x, (x**2).sum(1)) for n, (ids, x) in joined.items()}

    def answer(built: dict, q_ids: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
        if q.shape[1] not in built:
            return
        ids, x, squares = built[q.shape[1]]
        for at in range(0, len(q), 64):
            qs, own = q[at : at + 64], q_ids[at : at + 64]
            d2 = squares[None, :] - 2 * (qs @ x.T) + (qs**2).sum(1)[:, None]
            d2[own[:, None] == ids[None, :]] = np.inf
            kth = np.partition(d2, min(k, d2.shape[1]) - 1, axis=1)[:, min(k, d2.shape[1]) - 1]
            # What rounding of the expanded square may hide is ranked by the exact distance.
            slack = 1e-9 * ((qs**2).sum(1) + squares.max())
            a, b = np.nonzero((d2 <= (np.where(np.isfinite(kth), kth, np.inf) + slack)[:, None]) & np.isfinite(d2))
            exact = np.sqrt(((qs[a] - x[b]) ** 2).sum(1))
            top = best(a, ids[b], -exact, k)
            yield pa.RecordBatch.from_arrays([pa.array(own[a[top]]), pa.array(ids[b[top]]), pa.array(exact[top])], ["query_id", "vec_id", "score"])

    found = tile_search(dealt, each, int(tiles.sum()), ready, answer, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
