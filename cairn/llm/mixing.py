"""Mixing sources to target weights by entropy balancing.

Each document starts with rate 1. The rates nearest to that in relative entropy, at most ``cap``, that give every source
its target of tokens tilt documents exponentially by what the constraint counts, their tokens: rate = min(cap, exp(tilt of
the source x size of the document / mean size in the source)). Newton iterations solve the convex dual for the tilts, each
iteration one distributed sum over the (source, size) counts of all documents. Rates become whole copies by systematic
rounding in order of size, so that a source's copies miss its target by about one document at most; of ``PHASES`` starting
points each source takes the nearest.

Defined cases: null text has size 0; documents of size 0 take part with 0 words; null source is a source of its own and
sorts last; a source's target never exceeds ``cap`` times its size; repeated rows count each; an empty table gives an
empty result; extra columns are ignored. Reruns agree: ranks depend on the rows only, not on their place.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut, prepare, salted_rank

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
PHASES = 32
#: Parts that the rows of a source and size are ranked in: at least, and rows of a part where there are more.
SALTS, SALT_ROWS = 32, 50_000
NEWTON_STEPS = 60
#: Sources are a dimension table: the driver holds one row for each. More than this many is an error, not a cut.
MAX_SOURCES = 2_000_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Shares of ``total`` by weight; none above cap x its size, the excess reshared by weight until none is above."""
    size, weight = np.array(sizes, np.float64), np.array(weights, np.float64)
    out, free, left = np.zeros(len(size)), np.ones(len(size), bool), float(total)
    while free.any():
        share = np.where(free, weight * left / weight[free].sum(), 0.0)
        above = free & (share > cap * size)
        if not above.any():
            out[free] = share[free]
            break
        out[above] = cap * size[above]
        left = total - out[~free | above].sum()
        free &= ~above
    return out.tolist()


def _newton(counts: DataFrame, goal: DataFrame, cap: float, tolerance: float = 1e-9) -> DataFrame:
    """of (source), tilt: the roots of the dual's slope. ``counts``: source, size, n, x; ``goal``: source, source_size, target.

    A source's tokens rise with its tilt. A step is Newton's on their logarithm, and halves the bracket where it would leave
    it. A source that takes all its copies, or none, needs no tilt (null).
    """
    open_ = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * cap * (1 - 1e-9))
    state = goal.where(open_).select(F.col("source").alias("of"), F.col("target").alias("goal"), F.lit(0.0).alias("tilt"), F.lit(-math.inf).alias("low"), F.lit(math.inf).alias("high"), F.lit(1.0).alias("miss"))
    state = cut(state)
    for _ in range(NEWTON_STEPS):
        at = counts.join(state, F.col("source").eqNullSafe(F.col("of")))
        rate = F.least(F.exp(F.col("tilt") * F.col("x")), F.lit(cap))
        words = F.col("n") * F.col("size")
        sums = at.groupBy("of", "goal", "tilt", "low", "high").agg(F.sum(words * rate).alias("mass"), F.sum(F.when(rate < cap, words * F.col("x") * rate).otherwise(0.0)).alias("slope"))
        above = F.col("mass") > F.col("goal")
        low, high = F.when(above, F.col("low")).otherwise(F.col("tilt")), F.when(above, F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - F.log(F.col("mass") / F.col("goal")) * F.col("mass") / F.col("slope")
        middle = F.when(F.col("_low") == -math.inf, F.least(F.lit(-1.0), 2 * F.col("_high"))).when(F.col("_high") == math.inf, F.greatest(F.lit(1.0), 2 * F.col("_low"))).otherwise((F.col("_low") + F.col("_high")) / 2)
        miss = F.abs(F.col("mass") - F.col("goal")) / F.col("goal")
        sums = sums.withColumns({"_low": low, "_high": high, "_step": step, "miss": miss})
        fine = (F.col("mass") > 0) & (F.col("slope") > 0) & (F.col("_step") > F.col("_low")) & (F.col("_step") < F.col("_high"))
        tilt = F.when(F.col("miss") < tolerance, F.col("tilt")).when(fine, F.col("_step")).otherwise(middle)
        state = cut(sums.select("of", "goal", tilt.alias("tilt"), F.col("_low").alias("low"), F.col("_high").alias("high"), "miss"))
        worst = state.agg(F.max("miss")).first()[0]
        if worst is None or worst < tolerance:
            break
    return state.select("of", "tilt")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, id_col: str = "doc_id", columns: tuple[str, ...] = ()) -> DataFrame:
    """id, size, source_size, target, taken, copies, rate and ``columns`` of every document.

    ``weights`` are dealt to the sources in code point order, again and again; ``share`` times all words are shared.
    """
    spark = docs.sparkSession
    prepare(spark)
    own = [c for c in dict.fromkeys((id_col, "source", *columns))]
    base = cut(docs.select(*own, size_of(F.col("text")).alias("size")))
    counts = cut(base.groupBy("source", "size").agg(F.count("*").alias("n")))
    rows = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("w")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows = sorted(rows, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [int(r["w"]) for r in rows]
    found = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], share * sum(sizes), cap)
    goal = spark.createDataFrame([(r["source"], s, float(t)) for r, s, t in zip(rows, sizes, found, strict=True)], "source string, source_size long, target double")
    named = goal.select(F.col("source").alias("of"), F.col("source_size"), F.col("target"))
    counts = counts.join(named, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    # A document's size beside the mean of its source.
    mean = F.greatest(F.sum(F.col("size") * F.col("n")).over(W.partitionBy("source")) / F.sum("n").over(W.partitionBy("source")), F.lit(1e-9))
    counts = cut(counts.withColumn("x", F.col("size") / mean))
    tilts = _newton(counts.select("source", "size", "n", "x"), goal, cap)
    full = F.when(F.col("target") > 0, F.lit(cap)).otherwise(F.lit(0.0))
    rated = counts.join(tilts, F.col("source").eqNullSafe(F.col("of")), "left").select(*counts.columns, F.coalesce(F.least(F.exp(F.col("tilt") * F.col("x")), F.lit(cap)), full).alias("rate"))

    # Where a size's rates begin: what smaller sizes sum up to; a document's place among equals gives the rest.
    smaller = W.partitionBy("source").orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    rated = rated.withColumn("_under", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(smaller), F.lit(0.0))).select(F.col("source").alias("of"), F.col("size").alias("_size"), "source_size", "target", "rate", "_under")
    rated = cut(rated)
    salts = max(SALTS, math.ceil(base.count() / SALT_ROWS))
    ranked = salted_rank(base, ["source", "size"], [F.xxhash64(id_col), F.col(id_col)], F.xxhash64(id_col, F.lit(1)), salts, "_equal")
    placed = cut(ranked.join(rated, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("_size"))).drop("of", "_size"))

    def copies(phase: Column) -> Column:
        at = lambda k: F.floor(F.col("_under") + k * F.col("rate") + phase)
        return F.least(at(F.col("_equal") + 1) - at(F.col("_equal")), F.lit(int(cap))).cast("long")

    tried = placed.groupBy("source", "target").agg(*[F.sum(F.col("size") * copies(F.lit((p + 0.5) / PHASES))).alias(f"p{p}") for p in range(PHASES)])
    # Nearest to the target; the smaller phase at ties.
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"p{p}") - F.col("target")).alias("miss"), F.lit((p + 0.5) / PHASES).alias("phase")) for p in range(PHASES)]))["phase"]
    chosen = tried.select(F.col("source").alias("of"), best.alias("phase"))
    out = placed.join(chosen, F.col("source").eqNullSafe(F.col("of"))).withColumn("copies", copies(F.col("phase")))
    return out.select(*own, "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate")
