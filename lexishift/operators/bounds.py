"""Bounds and ranges that are tables of any size: values take the last bound at or before them, and what lies below a bound is counted.

Values and bounds are dealt together into ranges of keys and numbered there once; what the end of one range hands to the next is carried by a table of a row a range. Nothing is compared with every bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexishift.functions.keys import Profile, key
from lexishift.operators.order import before, bucketed, dominance_counts, rank
from lexishift.sources.shared import settled


def route_values(values: DataFrame, bounds: DataFrame, p: Profile) -> DataFrame:
    """(v, routed) of distinct ``values`` (v) under ``bounds`` (part, lo, hi): the partition whose lower bound (inclusive, null: open) is the last at or before
    the value, if the value lies below its upper bound (exclusive, null: open), else ``none``; null for null. Where partitions overlap, that which begins last counts."""
    start = bounds.select(F.lit(None).cast("string").alias("v"), F.coalesce(key(F.col("lo"), p), F.lit("")).alias("_k"), F.struct("part", key(F.col("hi"), p).alias("hi")).alias("_b"))
    both = values.select("v", key(F.col("v"), p).alias("_k"), F.lit(None).cast(start.schema["_b"].dataType).alias("_b")).unionByName(start)
    cut = bucketed(both, "_k")
    until = Window.partitionBy("_bucket").orderBy("_k", F.col("_b").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = cut.groupBy("_bucket").agg(F.max_by("_b", F.when(F.col("_b").isNotNull(), F.struct("_k", "_b.part"))).alias("_last"))
    met = cut.withColumn("_in", F.last("_b", ignorenulls=True).over(until)).filter("_b is null").join(before(per, "_last", "_edge", "last"), "_bucket")
    at = F.coalesce("_in", "_edge")
    return met.select("v", F.when(F.col("_k").isNotNull(), F.when(at.isNull() | (F.col("_k") >= at["hi"]), "none").otherwise(at["part"])).alias("routed"))


def route_by(df: DataFrame, bounds: DataFrame, p: Profile, col: str = "w") -> DataFrame:
    """``df`` with ``routed``. Values are routed once each, whatever their number of rows."""
    told = route_values(df.select(F.col(col).alias("v")).filter("v is not null").distinct(), bounds, p)
    return df.join(told, F.col(col) == F.col("v"), "left").drop("v")


def misplaced_by(df: DataFrame, bounds: DataFrame, p: Profile, col: str = "w", part: str = "part") -> DataFrame:
    """B2: rows whose stored partition is not the one they are routed to now."""
    return route_by(df, bounds, p, col).filter(~F.col(part).eqNullSafe(F.col("routed")))


def pruning_loss(df: DataFrame, bounds: DataFrame, p: Profile, values: DataFrame, col: str = "w", part: str = "part") -> DataFrame:
    """(v, routed, n_lost, n): for each of ``values`` (v) how many of its rows an equality lookup loses that reads only the partition it is routed to, and how many there are."""
    held = df.select(F.col(col).alias("v"), F.col(part).alias("_p")).groupBy("v", "_p").agg(F.count("*").alias("_n"))
    asked = route_values(values.select("v").filter("v is not null").distinct(), bounds, p)
    met = asked.join(held, "v", "left").groupBy("v", "routed")
    return met.agg(F.coalesce(F.sum(F.when(~F.col("_p").eqNullSafe(F.col("routed")), F.col("_n"))), F.lit(0)).alias("n_lost"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n"))


def repartition_by(df: DataFrame, bounds: DataFrame, p: Profile, col: str = "w", part: str = "part") -> tuple[DataFrame, DataFrame]:
    """(every row in the partition it is routed to, (part, n_before, n_after, n_in, n_out))."""
    routed = settled(route_by(df, bounds, p, col))
    move = F.array(F.struct(F.col(part).alias("p"), F.lit(1).alias("b"), F.lit(0).alias("a")), F.struct(F.col("routed").alias("p"), F.lit(0).alias("b"), F.lit(1).alias("a")))
    moved = (~F.col(part).eqNullSafe(F.col("routed"))).cast("int")
    each = routed.select(moved.alias("m"), F.explode(move).alias("x")).groupBy(F.col("x.p").alias("part"))
    counts = each.agg(F.sum("x.b").alias("n_before"), F.sum("x.a").alias("n_after"), F.sum(F.col("x.a") * F.col("m")).alias("n_in"), F.sum(F.col("x.b") * F.col("m")).alias("n_out"))
    return routed.withColumn(part, F.col("routed")).drop("routed"), counts


def count_below(points: DataFrame, bounds: DataFrame) -> DataFrame:
    """(q, n): how many of ``points`` (k, times) lie below each of ``bounds`` (q, k)."""
    times = F.lit(0).cast("long").alias("times")
    both = points.select(F.lit(None).cast("long").alias("q"), "k", F.col("times").cast("long").alias("times")).unionByName(bounds.select(F.col("q").cast("long").alias("q"), "k", times))
    cut = bucketed(both, "k")
    until = Window.partitionBy("_bucket").orderBy("k").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("_bucket", "k")
    off = before(cut.groupBy("_bucket").agg(F.sum("times").alias("_n")), "_n", "_off", "sum")
    met = cut.withColumn("_in", F.sum("times").over(until) - F.sum("times").over(same)).filter("q is not null").join(off, "_bucket")
    return met.select("q", (F.col("_in") + F.col("_off")).alias("n"))


def _dominated(points: DataFrame, cursors: DataFrame, across: str) -> DataFrame:
    """(q, n) for ``cursors`` (q, x, y): points (k, ``across``) with k below x and ``across`` at least y."""
    held = settled(points.select("k", F.col(across).alias("l"), F.monotonically_increasing_id().alias("_id")))
    placed = settled(rank(rank(held, F.struct("k", "_id"), "old"), F.struct("l", "_id"), "new").select("old", "new"))
    one = lambda c: F.lit(1).alias("times")
    old = count_below(held.select("k", one("k")), cursors.select("q", F.col("x").alias("k"))).withColumnRenamed("n", "old")
    new = count_below(held.select(F.col("l").alias("k"), one("l")), cursors.select("q", F.col("y").alias("k"))).withColumnRenamed("n", "new")
    asked = settled(old.join(new, "q"))
    found = dominance_counts(placed, asked, placed.count())
    return asked.select("q", F.col("old").alias("below")).join(found, "q", "left").select("q", "below", F.coalesce("n", F.lit(0)).alias("n"))


def skip_losses(df: DataFrame, stats: DataFrame, ranges: DataFrame, block: str, p: Profile, col: str = "w") -> DataFrame:
    """(*ranges, n_lost): for every one of ``ranges`` (rid, lo, hi; lo <= value < hi) the rows in it that lie in blocks which min/max skipping by ``stats`` (block, lo, hi) would not read.

    A row that lies within its block's bounds now is read with every range that holds it. Of the others, one below its block's least value l is lost to the ranges that end at or
    before l, one above its greatest value h to those that begin after h. Where the two have changed places (h < l), a row between them is lost to all ranges that hold it but those
that begin at or before h and end after l. All are counts of points by two places (:func:`dominance_counts`), so rows never meet ranges.
    """
    k = key(F.col(col), p)
    edges = stats.select(F.col(block).alias("_block"), key(F.col("lo"), p).alias("l"), key(F.col("hi"), p).alias("h"))
    rows = df.select(F.col(block).alias("_block"), col).join(edges, "_block").select(k.alias("k"), "l", "h")
    astray = settled(rows.filter((F.col("k") < F.col("l")) | (F.col("k") > F.col("h"))))
    held = settled(ranges.withColumn("_a", key(F.col("lo"), p)).withColumn("_b", key(F.col("hi"), p)).withColumn("_q", F.monotonically_increasing_id()))
    live = held.filter("_a < _b")
    under, over, between = astray.filter("k < l and k <= h"), astray.filter("k > h and k >= l"), astray.filter("k < l and k > h")
    at = lambda x, y: live.select(F.col("_q").alias("q"), F.col(x).alias("x"), F.col(y).alias("y"))
    n = lambda df, name, of="n": df.select(F.col("q").alias("_q"), F.col(of).alias(name))
    below = lambda df, x: count_below(df.select("k", F.lit(1).alias("times")), live.select(F.col("_q").alias("q"), F.col(x).alias("k")))
    high = settled(_dominated(over, at("_b", "_a"), "h"))
    parts = [
        (1, n(_dominated(under, at("_b", "_b"), "l"), "_1")), (-1, n(_dominated(under, at("_a", "_b"), "l"), "_2")),
        (1, n(high, "_3", "below")), (-1, n(high, "_4")), (-1, n(below(over, "_a"), "_5")),
        (1, n(below(between, "_b"), "_6")), (-1, n(below(between, "_a"), "_7")), (-1, n(_dominated(between.select(F.col("l").alias("k"), "h"), at("_b", "_a"), "h"), "_8")),
    ]
    counts = live.select("_q")
    for _, part in parts:
        counts = counts.join(part, "_q")
    lost = sum((sign * F.col(f"_{i}") for i, (sign, _) in enumerate(parts, 1)), F.lit(0))
    counts = counts.select("_q", lost.alias("n_lost"))
    return held.join(counts, "_q", "left").select(*ranges.columns, F.coalesce("n_lost", F.lit(0)).alias("n_lost"))
