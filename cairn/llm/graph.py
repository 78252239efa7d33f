"""Connected components of a link table, without bringing a component or the links to one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted

ROUNDS = 60


def _stars(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One star step on ``total`` edges a -> b with a > b (Kiveris et al. 2014): link a node's larger (or smaller) neighbours
    to its least one. The rows of a hub stay where they are."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
    joined = join_counted(both, least, "u", "n", 2 * total)
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: the least node of the component of every node that has a link. Self-links and repeats are harmless."""
    edges = cut(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    n = edges.count()
    for _ in range(ROUNDS if n else 0):
        grown = cut(_stars(edges, True, n))
        after = cut(_stars(grown, False, n))
        # Done once every node has one edge and no root is itself below another node.
        n, nodes = after.agg(F.count("*"), F.countDistinct("a")).first()
        inner = after.select("b").distinct().join(after.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count() if n == nodes else 1
        edges = after
        if not inner:
            break
    else:
        if n:
            raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
