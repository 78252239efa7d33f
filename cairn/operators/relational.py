"""Order-dependent and relational building blocks, as DataFrame plans that Catalyst can move around."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_wins(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order. The rank limit is applied before the shuffle as well."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def filtered_top_k(df: DataFrame, keep: Column, order: list[Column], k: int) -> DataFrame:
    """Filter first, then the k first rows: a filter after a top-k would give fewer."""
    return df.where(keep).orderBy(*order).limit(k)


def left_count(left: DataFrame, right: DataFrame, on: str, right_on: str, name: str) -> DataFrame:
    """``left`` with the number of matching rows of ``right`` (0 where none): pre-aggregated, so no row is multiplied."""
    counted = right.groupBy(F.col(right_on).alias("_k")).agg(F.count("*").alias(name))
    return left.join(counted, left[on] == counted["_k"], "left").drop("_k").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def full_outer_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """key, change: new, changed or vanished; equal rows are left out."""
    o, n = old.select(F.col(key).alias("_ok"), F.col(digest).alias("_od")), new.select(F.col(key).alias("_nk"), F.col(digest).alias("_nd"))
    change = F.when(F.col("_ok").isNull(), "new").when(F.col("_nk").isNull(), "vanished").when(~F.col("_od").eqNullSafe(F.col("_nd")), "changed")
    return o.join(n, F.col("_ok") == F.col("_nk"), "full_outer").select(F.coalesce("_ok", "_nk").alias(key), change.alias("change")).where("change IS NOT NULL")


#: Numbers of a block that runs are found in.
BLOCK = 1_000_000


def islands(df: DataFrame, value: str, group: str | None = None) -> DataFrame:
    """Runs of consecutive integers: first, last. Runs are found by block; only those at a block's edges are joined after.

    So what meets in one window is at most two runs a block, or a block's rows, and not all runs.
    """
    part = [group] if group else []
    distinct = df.where(F.col(value).isNotNull()).select(*part, F.col(value).cast("long").alias("_v")).distinct().withColumn("_b", F.floor(F.col("_v") / BLOCK))
    inside = W.partitionBy(*part, "_b").orderBy("_v")
    runs = distinct.withColumn("_i", F.col("_v") - F.row_number().over(inside)).groupBy(*part, "_b", "_i").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    edge = (F.col("_lo") == F.col("_b") * BLOCK) | (F.col("_hi") == F.col("_b") * BLOCK + BLOCK - 1)
    whole = runs.where(~edge).select(*part, F.col("_lo").alias("first"), F.col("_hi").alias("last"))
    over = W.partitionBy(*part).orderBy("_lo")
    new = F.when(F.lag("_hi").over(over) + 1 == F.col("_lo"), 0).otherwise(1)
    joined = runs.where(edge).withColumn("_new", new).withColumn("_run", F.sum("_new").over(over.rowsBetween(W.unboundedPreceding, 0)))
    return whole.unionByName(joined.groupBy(*part, "_run").agg(F.min("_lo").alias("first"), F.max("_hi").alias("last")).drop("_run"))


def range_text(df: DataFrame, value: str, limit: int = 12) -> DataFrame:
    """One row, text: runs like ``0001-0003, 0007`` in order, and after ``limit`` of them how many more there are."""
    runs = islands(df, value)
    shown = runs.orderBy("first").limit(limit).withColumn("_t", F.when(F.col("first") == F.col("last"), F.format_string("%04d", "first")).otherwise(F.format_string("%04d-%04d", "first", "last")))
    parts = shown.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "_t"))), lambda x: x["_t"]), ", ").alias("_text"))
    total = runs.agg(F.count("*").alias("_n"))
    more = F.when(F.col("_n") > limit, F.concat(F.lit(", ... (+"), (F.col("_n") - limit).cast("string"), F.lit(" more ranges)"))).otherwise(F.lit(""))
    return parts.crossJoin(F.broadcast(total)).select(F.when(F.col("_n") == 0, F.lit("none")).otherwise(F.concat("_text", more)).alias("text"))  # one row


def carry(df: DataFrame, key: list[str], order: list[str], bucket: Column, counted: Column | None = None, name: str = "section", following: str | None = None, kept: Column | None = None) -> DataFrame:
    """Running columns over the rows of a key in order, a bucket of them at a time, so that no task holds a whole key.

    ``bucket`` rises with ``order``. Added: ``name``, how often ``counted`` held up to a row; next_value, ``following`` of
    the next row; context, the next value of ``kept`` that is not null, the row's own first. What buckets hand on is one row
    for each.
    """
    rows = df.withColumn("_b", bucket)
    inside = W.partitionBy(*key, "_b").orderBy(*order)
    before, after = inside.rowsBetween(W.unboundedPreceding, 0), inside.rowsBetween(0, W.unboundedFollowing)
    flags = F.lit(False) if counted is None else F.coalesce(counted, F.lit(False))
    value = F.lit(None) if kept is None else kept
    rows = rows.withColumns({"_run": F.count_if(flags).over(before), "_kept": F.first(value, ignorenulls=True).over(after)})
    own = F.struct(*order)
    edges = rows.groupBy(*key, "_b").agg(F.count_if(flags).alias("_n"), F.min_by(F.struct(F.col(following or order[0]).alias("v")), own).alias("_first"), F.min_by("_kept", own).alias("_open"))
    buckets = W.partitionBy(*key).orderBy("_b")
    edges = edges.select(*key, "_b", (F.sum("_n").over(buckets) - F.col("_n")).alias("_base"), F.lead("_first").over(buckets)["v"].alias("_next"), F.first("_open", ignorenulls=True).over(buckets.rowsBetween(1, W.unboundedFollowing)).alias("_later"))
    out = rows.withColumns({"_lead": F.lead(F.col(following or order[0])).over(inside), "_last": F.row_number().over(W.partitionBy(*key, "_b").orderBy(*[F.desc(c) for c in order])) == 1})
    out = out.join(edges, [*key, "_b"])
    added = {name: (F.col("_base") + F.col("_run")).cast("long")}
    if following:
        added["next_value"] = F.when(F.col("_last"), F.col("_next")).otherwise(F.col("_lead"))
    if kept is not None:
        added["context"] = F.coalesce("_kept", "_later")
    return out.withColumns(added).drop("_b", "_run", "_kept", "_base", "_next", "_later", "_lead", "_last")


def overlap_anti(spans: DataFrame, others: DataFrame, key: str, start: str, end: str, width: int) -> DataFrame:
    """``spans`` that share no part [start, end) with any of ``others`` of the same key. Both are dealt by the cells of
    ``width`` that they touch, so a key's spans don't all meet each other."""
    cells = F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)))
    taken = others.where(F.col(end) > F.col(start)).select(F.col(key).alias("_k"), F.col(start).alias("_s"), F.col(end).alias("_e"), cells.alias("_c")).distinct()
    # A cell's spans as one list: a span looks through it without being multiplied.
    taken = taken.groupBy("_k", "_c").agg(F.collect_set(F.struct("_s", "_e")).alias("_taken"))
    mine = spans.where(F.col(end) > F.col(start)).select(key, start, end, cells.alias("_c")).distinct()
    hit = mine.join(taken, (F.col(key) == F.col("_k")) & (mine["_c"] == taken["_c"])).where(F.exists("_taken", lambda t: (F.col(start) < t["_e"]) & (t["_s"] < F.col(end))))
    return spans.join(hit.select(key, start, end).distinct(), [key, start, end], "left_anti")


def index_percentiles(df: DataFrame, value: str, group: list[str]) -> DataFrame:
    """min, p50 = x[n div 2], p90 = x[n*9 div 10], max of the sorted values: picked, not interpolated."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_c"))
    over = W.partitionBy(*group).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    # Positions from the counts of distinct values, so that a large group is a short list.
    placed = counted.withColumn("_to", F.sum("_c").over(over)).withColumn("_n", F.sum("_c").over(W.partitionBy(*group)))
    at = lambda i: F.min(F.when(F.col("_to") > i, F.col(value)))
    return placed.groupBy(*group).agg(F.max("_n").alias("n"), F.min(value).alias("min"), at(F.floor(F.col("_n") / 2)).alias("p50"), at(F.floor(F.col("_n") * 9 / 10)).alias("p90"), F.max(value).alias("max"))


def greedy_groups(sizes: Column, limit: int) -> Column:
    """Group number of each element of an array of sizes: a group is closed before it would exceed ``limit``.

    The fold keeps the places where groups begin, which are few; an element's group is how many of them lie before it.
    """
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("begins"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["used"] == 0) | (acc["used"] + x <= limit)
        return F.struct(F.when(fits, acc["used"] + x).otherwise(x).cast("long").alias("used"), (acc["at"] + 1).alias("at"), F.when(fits, acc["begins"]).otherwise(F.array_append(acc["begins"], acc["at"])).alias("begins"))

    begins = F.aggregate(sizes, start, step)["begins"]
    ends = F.concat(begins, F.array(F.size(sizes)))
    each = F.transform(ends, lambda end, g: F.array_repeat(g.cast("int"), end - F.coalesce(F.get(begins, g - 1), F.lit(0))))
    return F.flatten(each)
