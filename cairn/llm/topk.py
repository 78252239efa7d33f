"""Exact top-k by inner product: columnar branch and bound.

Vectors are quantised to integers. Candidates are dealt to tiles of bounded size and laid out by dimension; each query is
sent to every tile, and a tile's task reads its candidates first and then streams the queries, so no task and no driver
holds all queries. Scores grow block by block of dimensions, and after each block the candidates are compacted to those that
can still reach a query's k-th score, of which a few exactly scored candidates give the first bound: what is left of a
score is at most the product of the remaining norms. A tile sends k rows a query at most.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part; vectors are compared with
those of their own dimension; a query is compared with rows of other ids; of query rows that repeat an id the least
vector counts, candidate rows that repeat an id count each; ties go to the smaller id; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, prepare

SCALE = 256
#: Candidates of a tile, about; fewer where that leaves cores idle.
TILE_ROWS = 65_536
ROWS_AT_ONCE, QUERIES_AT_ONCE = 8192, 256
DIMENSIONS_AT_ONCE = 16
#: Candidates that a query is scored against exactly for its first bound.
FIRST = 256
#: Below this share of survivors they are gathered; above it whole blocks are multiplied.
COMPACT_BELOW = 0.15


def valid(vector: Column, nonzero: bool = False) -> Column:
    fine = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0) if nonzero else fine, F.lit(False))


def matrices(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors as double) of each dimension."""
    ids, sizes = ids.to_numpy(zero_copy_only=False), vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.cumsum(sizes) - sizes
    for d in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == d)
        yield ids[own], flat[at[own][:, None] + np.arange(d)]


Held = dict[int, list[tuple[np.ndarray, np.ndarray]]]


def tile_search(rows: DataFrame, queries: DataFrame, tiles: int, ready: Callable[[Held], dict], answer: Callable[[dict, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``answer`` for each batch of queries that meets a tile; rows, queries: tile, id, v, a query once for each tile it meets.

    ``ready`` gets the (ids, vectors) of a tile's rows by dimension. Rows of a tile sort before its queries, so a task
    holds one tile and one batch of queries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, built = None, {}, None
        for b in batches:
            tile, ask = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.append(True, (tile[1:] != tile[:-1]) | (ask[1:] != ask[:-1])))
            for a, e in zip(edges.tolist(), [*edges[1:].tolist(), len(tile)], strict=True):
                if tile[a] != now:
                    now, held, built = tile[a], {}, None
                for ids, x in matrices(b.column(2).slice(a, e - a), b.column(3).slice(a, e - a)):
                    if not ask[a]:
                        held.setdefault(x.shape[1], []).append((ids, x))
                        continue
                    built = ready(held) if built is None else built
                    yield from answer(built, ids, x)

    both = rows.select("tile", F.lit(False).alias("ask"), "id", "v").unionByName(queries.select("tile", F.lit(True).alias("ask"), "id", "v"))
    return both.repartition(min(tiles, 1 << 15), "tile").sortWithinPartitions("tile", "ask").mapInArrow(run, schema)


def best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k highest scores of each query, ties to smaller ids; sorted by query and rank."""
    order = np.lexsort((ids, -scores, query))
    q = query[order]
    first = np.searchsorted(q, q)
    return order[np.arange(len(q)) - first < k]


class Block:
    """Candidates by dimension, those in which they are large first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids = ids
        self.order = np.argsort(-np.abs(vectors).mean(0), kind="stable")
        self.edges = [*range(0, vectors.shape[1], DIMENSIONS_AT_ONCE), vectors.shape[1]]
        self.tails, self.columns = self.left(vectors[:, self.order]), np.ascontiguousarray(vectors[:, self.order].T)

    def left(self, m: np.ndarray) -> np.ndarray:
        """Norm of what is left of each row from each edge on."""
        return np.stack([np.sqrt((m[:, e:] ** 2).sum(1)) for e in self.edges], 1)


class Search:
    """The best k of each query over the blocks seen so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, vectors, k
        self.kth = np.full(len(ids), -np.inf)
        self.found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float64))

    def add(self, block: Block) -> None:
        q = self.q[:, block.order]
        tails = block.left(q)
        if len(block.ids) > self.k and not np.isfinite(self.kth).all():
            score = q @ block.columns[:, :FIRST]
            score[self.ids[:, None] == block.ids[None, :FIRST]] = -np.inf
            if score.shape[1] >= self.k:
                self.kth = np.maximum(self.kth, np.partition(score, -self.k, axis=1)[:, -self.k])
        # A bound counts as met within this much.
        least = self.kth - 1e-6 * (1 + np.abs(np.where(np.isfinite(self.kth), self.kth, 0)))
        score, alive = np.zeros((len(q), len(block.ids))), None
        for step, (lo, hi) in enumerate(zip(block.edges[:-1], block.edges[1:], strict=True), 1):
            if alive is None:
                score += q[:, lo:hi] @ block.columns[lo:hi]
                keep = score + tails[:, step][:, None] * block.tails[:, step] >= least[:, None]
                if hi == block.edges[-1] or np.count_nonzero(keep) < COMPACT_BELOW * keep.size:
                    alive = np.nonzero(keep)
                    score = score[alive]
            else:
                rows, cols = alive
                score = score + np.einsum("id,di->i", q[rows, lo:hi], block.columns[lo:hi, cols])
                keep = score + tails[rows, step] * block.tails[cols, step] >= least[rows]
                alive, score = (rows[keep], cols[keep]), score[keep]
        rows, cols = alive if alive is not None else (np.empty(0, np.int64), np.empty(0, np.int64))
        other = self.ids[rows] != block.ids[cols]
        q_all = np.concatenate([self.found[0], rows[other]])
        id_all = np.concatenate([self.found[1], block.ids[cols[other]]])
        s_all = np.concatenate([self.found[2], score[other]])
        top = best(q_all, id_all, s_all, self.k)
        self.found = (q_all[top], id_all[top], s_all[top])
        full = np.bincount(self.found[0], minlength=len(self.ids)) >= self.k
        last = np.full(len(self.ids), np.inf)
        np.minimum.at(last, self.found[0], self.found[2])
        self.kth = np.where(full, last, self.kth)


def _exact(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Components too large for exact doubles: whole numbers of any size; scores are held to the range of a long."""
    big = lambda m: [[int(v) for v in row] for row in m]
    out, xs = [], big(x)
    for qi, row in zip(q_ids.tolist(), big(q), strict=True):
        scored = sorted((-sum(a * b for a, b in zip(row, other, strict=True)), i) for i, other in zip(ids.tolist(), xs, strict=True) if i != qi)
        out += [(qi, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for s, i in scored[:k]]
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score (integer inner product of floor(scale * x))."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.where(valid(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    tiles = max(4 * spark.sparkContext.defaultParallelism, math.ceil(rows.count() / TILE_ROWS))
    queries = cut(rows.where("is_query").groupBy("id").agg(F.min("v").alias("v")))
    each = queries.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    dealt = rows.withColumn("tile", F.pmod(F.xxhash64("id", "v"), F.lit(tiles)).cast("int"))
    names = ["query_id", "vec_id", "score"]

    def ready(held: Held) -> dict:
        out = {}
        for d, parts in held.items():
            ids, x = np.concatenate([p[0] for p in parts]), np.floor(scale * np.concatenate([p[1] for p in parts]))
            runs = [slice(a, a + ROWS_AT_ONCE) for a in range(0, len(ids), ROWS_AT_ONCE)]
            out[d] = float(np.abs(x).max()), [(x[r], Block(ids[r], x[r])) for r in runs]
        return out

    def answer(built: dict, ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        d = x.shape[1]
        if d not in built:
            return
        x, (most, blocks) = np.floor(scale * x), built[d]
        if most * np.abs(x).max() * d >= 2.0**52:
            large = [r for own, block in blocks for r in _exact(ids, x, block.ids, own, k)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in large], pa.int64()) for j in range(3)], names)
            return
        for at in range(0, len(ids), QUERIES_AT_ONCE):
            search = Search(ids[at : at + QUERIES_AT_ONCE], x[at : at + QUERIES_AT_ONCE], k)
            for _, block in blocks:
                search.add(block)
            of, found, scores = search.found
            yield pa.RecordBatch.from_arrays([pa.array(search.ids[of]), pa.array(found), pa.array(scores.astype(np.int64))], names)

    out = tile_search(dealt, each, tiles, ready, answer, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
