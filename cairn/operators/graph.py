"""Graph and distance operators: breadth-first neighbourhoods and radius joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.geodesy import footpoint
from cairn.operators.once import once

#: Nodes of a frontier that is sent to every task; a larger one meets the edges by an exchange.
FEW = 100_000


def neighbourhood(edges: DataFrame, source: str, target: str, start: DataFrame, depth: int = 1) -> DataFrame:
    """node, depth: nodes within max(1, depth) steps of ``start`` (column node) in either direction; cycle-safe."""
    both = edges.select(F.col(source).alias("node"), F.col(target).alias("next")).unionByName(edges.select(F.col(target).alias("node"), F.col(source).alias("next"))).where("node <> next")
    seen = once(start.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = seen.select("node")
    for step in range(1, max(1, depth) + 1):
        # Edges meet the frontier as they are read, and only what they lead to is made distinct: never all edges.
        few = frontier.limit(FEW + 1).count() <= FEW
        reached = both.join(F.broadcast(frontier) if few else frontier, "node", "left_semi").select(F.col("next").alias("node"))
        frontier = once(reached.distinct().join(seen, "node", "left_anti"))
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(step)))
    return seen


def nearby(points: DataFrame, key: str, x: str, y: str, origin: int, radius: float, k: int = 20) -> DataFrame:
    """key, distance of points within ``radius`` (inclusive) of one origin, nearest first; an origin without a place has none."""
    o = points.where((F.col(key) == origin) & F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("_ox"), F.col(y).alias("_oy")).limit(1)
    d2 = (F.col(x) - F.col("_ox")) ** 2 + (F.col(y) - F.col("_oy")) ** 2
    near = points.where(F.col(key) != origin).crossJoin(F.broadcast(o)).withColumn("_d2", d2).where(F.col("_d2") <= radius * radius)  # one row
    return near.orderBy("_d2", key).limit(k).select(key, F.sqrt("_d2").alias("distance"))


def radius_join(points: DataFrame, key: str, x: str, y: str, radius: float) -> DataFrame:
    """a, b, distance: all pairs a < b within ``radius``. Points meet by grid cell of that size, so it is an equi-join."""
    cell = lambda c: F.floor(F.col(c) / radius)
    p = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(key).alias("_k"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), cell(x).alias("_cx"), cell(y).alias("_cy"))
    steps = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left = p.select(F.col("_k").alias("a"), F.col("_x").alias("ax"), F.col("_y").alias("ay"), "_cx", "_cy", F.explode(steps).alias("s"))
    left = left.select("a", "ax", "ay", (F.col("_cx") + F.col("s.dx")).alias("_cx"), (F.col("_cy") + F.col("s.dy")).alias("_cy"))
    d2 = (F.col("ax") - F.col("_x")) ** 2 + (F.col("ay") - F.col("_y")) ** 2
    pairs = left.join(p, ["_cx", "_cy"]).where(F.col("a") < F.col("_k")).withColumn("_d2", d2).where(F.col("_d2") <= radius * radius)
    return pairs.select("a", F.col("_k").alias("b"), F.sqrt("_d2").alias("distance"))


def utm_to_wgs84(easting: Column, northing: Column, zone: int = 30) -> tuple[Column, Column]:
    """Latitude and longitude (degrees, not rounded: a reader that rounds would round twice) of UTM coordinates on the northern half."""
    return footpoint(easting, northing, zone, F)
