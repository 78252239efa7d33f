"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Labelled examples (a bounded sample, ``EXAMPLES`` of each label) are vectors over every term they hold: (1 + ln tf) x idf,
times 1 plus what the term's rates in the two labels lie apart beyond ``SURE`` standard errors. The index holds each term's
postings by blocks of examples with the largest weight in each block. A query adds up the blocks' bounds, scores blocks
from the highest bound down and stops where no block can reach its k-th cosine: the neighbours are those of exhaustive
search. Votes weighted by the squared cosine and corrected for the sampling rates, with a little weight for the rate of all
labelled rows, are calibrated by isotonic regression on the examples themselves, each left out of its own vote.

Defined cases: null and empty texts, and texts without a term of the examples, have no neighbours, so theirs is the
calibrated rate of all labelled rows; texts are read whole; with no usable labels the score is 0 for all; labels that are
null, or of null ids, are not used; of labels that repeat an id the largest counts, of texts that repeat it the one that
sorts first; rows that repeat a doc_id are scored each; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, doc_mod, prepare, spread

#: Labelled examples of each label that the classifier is fitted on, at most.
EXAMPLES = 1500
NEIGHBOURS = 30
BLOCK = 128
#: Standard errors from which on a difference of a term's rates counts.
SURE = 3.0
#: Weight of the rate of all labelled rows in a vote; a neighbour's is its squared cosine.
PRIOR = 0.05
#: Terms that stand in at least one of so many examples, but at most so many of them, are frequent.
OFTEN, MOST_OFTEN = 32, 512
AT_ONCE = 128
_TERM = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> Counter:
    return Counter(_TERM.findall(text.lower())) if text else Counter()


@dataclass
class Index:
    vocabulary: dict[str, int]
    #: Of each term: idf times what it tells; the last: idf of a term that no example holds.
    weight: np.ndarray
    #: Weights of the frequent terms, which come first in the vocabulary, by term and example.
    dense: np.ndarray
    labels: np.ndarray
    votes: np.ndarray
    ids: np.ndarray
    rate: float
    #: Postings of the other terms: examples in ascending order with weights; by term and block: the first posting and the bound.
    post_id: np.ndarray
    post_w: np.ndarray
    block_at: np.ndarray
    block_id: np.ndarray
    block_from: np.ndarray
    block_max: np.ndarray
    #: Votes and the scores they stand for, both rising.
    curve: tuple[np.ndarray, np.ndarray]

    def vector(self, counted: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Known terms and their weights; with those of the other terms, which no example holds, of length 1."""
        place = self.vocabulary.get
        t = np.array([place(x, -1) for x in counted], np.int64)
        w = (1 + np.log(np.fromiter(counted.values(), float, len(t)))) * self.weight[t]
        by = np.argsort(t)[np.count_nonzero(t < 0) :]
        return t[by], w[by] / max(1e-300, np.linalg.norm(w))

    def neighbours(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, but: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each vector the k examples of the largest cosine above 0 (other than ``but``), ties to the smaller place, and
        the cosines."""
        often = len(self.dense)
        q = np.zeros((len(vectors), often))
        for i, (t, w) in enumerate(vectors):
            n = np.searchsorted(t, often)
            q[i, t[:n]] = w[:n]
        common = q @ self.dense
        for i, (t, w) in enumerate(vectors):
            n = np.searchsorted(t, often)
            yield self._near(common[i], t[n:], w[n:], k, -1 if but is None else but[i])

    def _near(self, common: np.ndarray, t: np.ndarray, w: np.ndarray, k: int, but: int) -> tuple[np.ndarray, np.ndarray]:
        """``common``: what the frequent terms give each example; t, w: the others."""
        if not len(common):
            return np.empty(0, np.int64), common
        n = self.block_at[t + 1] - self.block_at[t]
        entries, weight = spread(self.block_at[t], n), np.repeat(w, n)
        blocks, starts = self.block_id[entries], np.arange(0, len(common), BLOCK)
        bound = np.maximum.reduceat(common, starts) + np.bincount(blocks, weights=weight * self.block_max[entries], minlength=len(starts))
        order = np.argsort(-bound, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        by = np.argsort(place[blocks], kind="stable")
        entries, weight, edges = entries[by], weight[by], np.searchsorted(place[blocks][by], np.arange(len(order) + 1))
        cosines, kth, at, step = np.zeros(len(common)), 0.0, 0, 2
        while at < len(order) and bound[order[at]] > 0 and bound[order[at]] >= kth - 1e-12:
            to = min(len(order), at + step)
            own = slice(edges[at], edges[to])
            size = self.block_from[entries[own] + 1] - self.block_from[entries[own]]
            places = spread(self.block_from[entries[own]], size)
            cosines += np.bincount(self.post_id[places], weights=np.repeat(weight[own], size) * self.post_w[places], minlength=len(cosines))
            for x in order[at:to].tolist():
                cosines[x * BLOCK : (x + 1) * BLOCK] += common[x * BLOCK : (x + 1) * BLOCK]
            if but >= 0:
                cosines[but] = 0
            kth = np.partition(cosines, -k)[-k] if len(cosines) >= k else 0.0
            at, step = to, step * 2
        near = np.flatnonzero(cosines >= max(kth, 1e-12))
        top = near[np.lexsort((near, -cosines[near]))][:k]
        return top, cosines[top]

    def votes_of(self, counted: list[Counter], but: list[int] | None = None) -> Iterator[tuple[float, np.ndarray]]:
        for near, cosines in self.neighbours([self.vector(c) for c in counted], NEIGHBOURS, but):
            weight = cosines**2 * self.votes[near]
            yield float((weight @ self.labels[near] + PRIOR * self.rate) / (weight.sum() + PRIOR)), near

    def score(self, counted: list[Counter]) -> Iterator[tuple[float, list[int]]]:
        """Score and evidence of each text."""
        for at in range(0, len(counted), AT_ONCE):
            for raw, near in self.votes_of(counted[at : at + AT_ONCE]):
                yield (float(np.interp(raw, *self.curve)), self.ids[near].tolist()) if len(self.labels) else (0.0, [])


def _isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean place and value of the pools of the rising function nearest to y."""
    pools: list[list[float]] = []
    for i in np.argsort(x, kind="stable"):
        pools.append([x[i] * w[i], y[i] * w[i], w[i], x[i]])
        while len(pools) > 1 and (pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2] or pools[-2][3] == pools[-1][3]):
            a, b, c, last = pools.pop()
            pools[-1] = [pools[-1][0] + a, pools[-1][1] + b, pools[-1][2] + c, last]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def _telling(toxic: np.ndarray, clean: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """1, and beyond SURE standard errors between the shares of toxic and of clean examples with a term, the excess more."""
    if not n1 or not n0:
        return np.ones(len(toxic))
    p = (toxic + clean) / (n1 + n0)
    error = np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
    return 1 + np.maximum(0, np.abs(toxic / n1 - clean / n0) / error - SURE)


def fit(ids: list[int], counted: list[Counter], labels: list[int], rates: tuple[float, float]) -> Index:
    """``counted``: terms of the examples; ``rates``: labelled rows for each example of label 0 and of label 1."""
    # Examples that share their most frequent term, so those of a language, lie in the same blocks.
    lead = [min(((-n, t) for t, n in c.items()), default=(0, ""))[1] for c in counted]
    order = sorted(range(len(ids)), key=lambda i: (lead[i], labels[i], ids[i]))
    ids, counted, y = [ids[i] for i in order], [counted[i] for i in order], np.array([labels[i] for i in order], np.int64)
    held = Counter(t for c in counted for t in c)
    often = sorted((t for t, n in held.items() if n * OFTEN >= len(ids)), key=lambda t: (-held[t], t))[:MOST_OFTEN]
    vocabulary = {t: i for i, t in enumerate([*often, *sorted(held.keys() - set(often))])}
    own = [sorted((vocabulary[t], n) for t, n in c.items()) for c in counted]
    term, example = np.array([t for o in own for t, _ in o], np.int64), np.repeat(np.arange(len(own)), [len(o) for o in own])
    n1, df = int(y.sum()), np.bincount(term, minlength=len(vocabulary))
    toxic = np.bincount(term, weights=y[example], minlength=len(vocabulary))
    weight = (np.log((1 + len(y)) / (1 + df)) + 1) * _telling(toxic, df - toxic, n1, len(y) - n1)
    value = (1 + np.log(np.array([n for o in own for _, n in o], float))) * weight[term]
    value /= np.sqrt(np.bincount(example, weights=value**2, minlength=len(own)))[example]
    dense = np.zeros((len(often), len(own)))
    dense[term[term < len(often)], example[term < len(often)]] = value[term < len(often)]
    by = np.lexsort((example, term))[np.count_nonzero(term < len(often)) :]
    term, example, value = term[by], example[by], value[by]
    first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (example[1:] // BLOCK != example[:-1] // BLOCK))[: len(term)])
    votes = np.where(y == 1, rates[1], rates[0]).astype(float)
    votes /= votes.mean() if len(votes) else 1
    index = Index(
        vocabulary, np.append(weight, np.log(1 + len(y)) + 1), dense, y.astype(float), votes, np.array(ids, np.int64), float(votes @ y / max(1e-9, votes.sum())), example.astype(np.int32), value,
        np.searchsorted(term[first], np.arange(len(vocabulary) + 1)), example[first] // BLOCK, np.append(first, len(term)), np.maximum.reduceat(value, first) if len(first) else value, (np.zeros(1), np.zeros(1)),
    )
    if len(y):
        raws = np.array([raw for raw, _ in index.votes_of(counted, list(range(len(y))))])
        index.curve = _isotonic(raws, index.labels, votes)
    return index


def learn(docs: DataFrame, labels: DataFrame, keep: Column) -> Index:
    """``docs``: doc_id, text; ``labels``: doc_id, toxic. Examples of each label are those of the smallest id hashes."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & keep).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    drawn = None
    for k in (0, 1):
        part = known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES)
        drawn = part if drawn is None else drawn.unionByName(part)
    drawn = cut(drawn)  # 2 x EXAMPLES rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [terms(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([list(c) for c in each], pa.list_(pa.string())), pa.array([list(c.values()) for c in each], pa.list_(pa.int32()))], ["doc_id", "toxic", "terms", "counts"])

    texts = docs.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").cast("int").alias("toxic"))
    rows = texts.select("doc_id", "text", "toxic").mapInArrow(count, "doc_id long, toxic int, terms array<string>, counts array<int>").collect()
    rows.sort(key=lambda r: r["doc_id"])
    taken = Counter(r["toxic"] for r in rows)
    rates = tuple(sizes.get(k, 0) / max(1, taken[k]) for k in (0, 1))
    return fit([r["doc_id"] for r in rows], [Counter(dict(zip(r["terms"], r["counts"], strict=True))) for r in rows], [r["toxic"] for r in rows], rates)


def score(docs: DataFrame, index: Index, held_out: Column) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (doc_ids of the nearest examples)."""
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            texts = pc.fill_null(b.column(2), "").dictionary_encode()
            found = list(own.score([terms(t) for t in texts.dictionary.to_pylist()]))
            scores, evidence = zip(*(found[i] for i in texts.indices.to_pylist()), strict=True) if b.num_rows else ((), ())
            value = np.array(scores, np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(value), pa.array((value >= 0.5).astype(np.int32)), pa.array(evidence, pa.list_(pa.int64()))], ["doc_id", "held_out", "score", "predicted", "evidence"])

    return docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, evidence array<long>")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels whose crc32(doc_id) mod 5 is not 0 and score every document."""
    prepare(docs.sparkSession)
    index = learn(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), doc_mod(F.col("doc_id"), 5) != 0)
    return score(docs, index, doc_mod(F.col("doc_id"), 5) == 0)
