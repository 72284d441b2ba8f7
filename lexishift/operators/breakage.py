"""Stored data that changes meaning when text rules change: found and repaired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexishift.functions.keys import Profile, key
from lexishift.operators.order import rank, ranks
from lexishift.sources.shared import settled


def route(col: Column, bounds: list[tuple[str, str | None, str | None]], p: Profile) -> Column:
    """The partition a value goes to: (name, from inclusive, to exclusive), null for open. Bounds are a table
    definition, so they are literals and their keys fold; a value that fits nowhere is an error row, ``none``."""
    out = F.lit("none")
    for name, lo, hi in reversed(bounds):
        inside = F.lit(True)
        if lo is not None:
            inside = inside & (key(col, p) >= key(F.lit(lo), p))
        if hi is not None:
            inside = inside & (key(col, p) < key(F.lit(hi), p))
        out = F.when(inside, name).otherwise(out)
    return F.when(col.isNotNull(), out)


def misplaced(df: DataFrame, bounds, p: Profile, col: str = "w", part: str = "part") -> DataFrame:
    """B2: rows whose stored partition is not the one they are routed to now."""
    return df.withColumn("routed", route(F.col(col), bounds, p)).filter(~F.col(part).eqNullSafe(F.col("routed")))


def repartition_fix(df: DataFrame, bounds, p: Profile, col: str = "w", part: str = "part") -> DataFrame:
    """Every row in the partition it is routed to."""
    return df.withColumn(part, route(F.col(col), bounds, p))


def range_drift(df: DataFrame, lo: str, hi: str, old: Profile, new: Profile, col: str = "w") -> DataFrame:
    """R2: rows that leave, enter and stay in a range, in one pass."""
    inside = lambda p: (key(F.col(col), p) >= key(F.lit(lo), p)) & (key(F.col(col), p) < key(F.lit(hi), p))
    a, b = inside(old), inside(new)
    return df.withColumn("status", F.when(a & b, "stay").when(a, "leave").when(b, "enter")).filter("status is not null").groupBy("status").agg(F.count("*").alias("n"))


def check_violations(df: DataFrame, predicate: Column) -> DataFrame:
    """Stored rows that a predicate now rejects; an unknown answer passes."""
    return df.filter(~F.coalesce(predicate, F.lit(True)))


def stale(df: DataFrame, stored: str, expression: Column) -> DataFrame:
    """Rows whose stored value is not what the expression gives now."""
    return df.filter(~F.col(stored).eqNullSafe(expression))


def recompute(df: DataFrame, stored: str, expression: Column) -> DataFrame:
    """The stored column rewritten."""
    return df.withColumn(stored, expression)


def stale_positions(df: DataFrame, old: Profile, new: Profile) -> DataFrame:
    """Stored places and places now, where they differ."""
    both = rank(rank(df, key(F.col("w"), old), "stored"), key(F.col("w"), new), "now")
    return both.filter("stored <> now")


def subset_drift(df: DataFrame, was: Column, now: Column) -> DataFrame:
    """Rows in a stored subset and in the same subset now, counted by both."""
    return df.groupBy(F.coalesce(was, F.lit(False)).alias("stored"), F.coalesce(now, F.lit(False)).alias("now")).agg(F.count("*").alias("n"))


def duplicates(df: DataFrame, by: Column) -> DataFrame:
    """Values stored more than once."""
    return df.groupBy(by.alias("value")).agg(F.count("*").alias("n")).filter("n > 1")


def dedup_keep_first(df: DataFrame, by: str, order: str) -> DataFrame:
    """Of each value the row that comes first; an aggregate, so a value that most rows share combines before the shuffle."""
    rest = [c for c in df.columns if c not in (by, order)]
    return df.groupBy(by).agg(F.min_by(F.struct(order, *rest), order).alias("_r")).select(by, "_r.*")


def fk_orphans(child: DataFrame, parent: DataFrame, on: str) -> DataFrame:
    """Child rows without a parent (a null reference is none)."""
    return child.filter(F.col(on).isNotNull()).join(parent.select(on).distinct(), on, "left_anti")


def fk_blocked_deletes(parent: DataFrame, child: DataFrame, on: str) -> DataFrame:
    """Parents that are still referenced, with how many rows do; children are counted before the join."""
    return parent.select(on).distinct().join(child.groupBy(on).agg(F.count("*").alias("n")), on)


def block_stats(df: DataFrame, block: str, p: Profile, col: str = "w") -> DataFrame:
    """Least and greatest value of each block of rows under a profile."""
    return df.groupBy(block).agg(F.min_by(col, key(F.col(col), p)).alias("lo"), F.max_by(col, key(F.col(col), p)).alias("hi"))


def block_skip_loss(df: DataFrame, stats: DataFrame, block: str, lo: str, hi: str, p: Profile, col: str = "w") -> DataFrame:
    """Rows in [lo, hi) now, in blocks that min/max skipping would not read."""
    inside = df.filter((key(F.col(col), p) >= key(F.lit(lo), p)) & (key(F.col(col), p) < key(F.lit(hi), p)))
    read = stats.filter((key(F.col("hi"), p) >= key(F.lit(lo), p)) & (key(F.col("lo"), p) < key(F.lit(hi), p))).select(block)
    return inside.join(read, block, "left_anti")


def prefix_sweep(df: DataFrame, stats: DataFrame, block: str, length: int, p: Profile, col: str = "w") -> DataFrame:
    """B20 for the range of every prefix: rows with the prefix that lie in blocks which skipping for its range would not read.

    A prefix's range goes from its least to its greatest key now; a block is read if its own range [lo, hi] meets that. Rows
    are counted by (block, prefix) before anything is joined.
    """
    k = key(F.col(col), p)
    held = df.groupBy(block, F.substring(col, 1, length).alias("prefix")).agg(F.count("*").alias("n"), F.min(k).alias("_a"), F.max(k).alias("_b"))
    ranges = held.groupBy("prefix").agg(F.min("_a").alias("_from"), F.max("_b").alias("_to"))
    edges = stats.select(block, key(F.col("lo"), p).alias("_l"), key(F.col("hi"), p).alias("_h"))
    met = held.select(block, "prefix", "n").join(ranges, "prefix").join(edges, block).withColumn("lost", (F.col("_h") < F.col("_from")) | (F.col("_l") > F.col("_to")))
    return met.groupBy("prefix").agg(F.sum(F.when(F.col("lost"), F.col("n")).otherwise(0)).alias("n_lost"), F.sum("n").alias("n")).filter("n_lost > 0")


def histogram(df: DataFrame, p: Profile, n: int) -> DataFrame:
    """N + 1 equi-depth bounds, exact."""
    placed = settled(rank(df, key(F.col("w"), p)))
    total = placed.agg(F.max("rank")).first()[0] or 0
    at = sorted({1 + (i * (total - 1)) // n for i in range(n + 1)}) if total else []
    return placed.filter(F.col("rank").isin(at)).select("rank", "w")


def admit(batch: DataFrame, unique: DataFrame, parent: DataFrame, check: Column, col: str = "w") -> DataFrame:
    """What each incoming row would get: ACCEPTED, REJECTED and by what, NOT ASKED where its value is missing."""
    taken, known = unique.select(F.col(col).alias("_t")).distinct(), parent.select(F.col(col).alias("_p")).distinct()
    joined = batch.join(taken, F.col(col) == F.col("_t"), "left").join(known, F.col(col) == F.col("_p"), "left")
    why = F.when(F.col("_t").isNotNull(), "unique").when(F.col("_p").isNull(), "foreign key").when(~F.coalesce(check, F.lit(True)), "check")
    return joined.withColumn("why", why).select(
        *batch.columns, F.when(F.col(col).isNull(), "NOT ASKED").when(F.col("why").isNull(), "ACCEPTED").otherwise("REJECTED").alias("answer"), F.when(F.col(col).isNull(), "missing input").otherwise(F.col("why")).alias("why")
    )


def three_state(metrics: DataFrame) -> DataFrame:
    """(metric, state, value) side by side for states A, B, C."""
    return metrics.groupBy("metric").pivot("state", ["A", "B", "C"]).agg(F.max("value"))


def keyset_page(df: DataFrame, after: str, n: int, p: Profile) -> DataFrame:
    """The page after a cursor."""
    k = key(F.col("w"), p)
    return df.filter(k > key(F.lit(after), p)).orderBy(k).limit(n)


def first_rows(df: DataFrame, n: int, p: Profile) -> DataFrame:
    """The first n rows of an order."""
    return df.orderBy(key(F.col("w"), p)).limit(n)


def best_rank(hits: DataFrame, obj: str = "obj") -> DataFrame:
    """Of an object's hits those of the best rank, labels joined. Equal labels combine before the shuffle, and an object's few ranks after it."""
    per = hits.groupBy(obj, "rank").agg(F.array_join(F.array_sort(F.collect_set("label")), ", ").alias("labels"))
    return per.groupBy(obj).agg(F.min(F.struct("rank", "labels")).alias("_b")).select(obj, "_b.rank", "_b.labels")


def class_violations(df: DataFrame, outside: DataFrame, col: str = "w") -> DataFrame:
    """Distinct values with a character of ``outside`` (c), the characters that the class no longer has; they meet by character."""
    parts = df.select(col).distinct().select(col, F.explode(F.array_distinct(F.filter(F.split(F.col(col), ""), lambda x: x != ""))).alias("c"))
    return parts.join(outside.select("c").distinct(), "c", "left_semi").select(col).distinct()


def stale_expression_key(df: DataFrame, stored: str, expression: Column) -> DataFrame:
    """Rows per group of a stored comparison result, and of the live one; a group that one of them lacks counts 0."""
    both = F.explode(F.array(F.struct(F.col(stored).alias("g"), F.lit(1).alias("s"), F.lit(0).alias("l")), F.struct(expression.alias("g"), F.lit(0).alias("s"), F.lit(1).alias("l"))))
    return df.select(both.alias("x")).groupBy(F.col("x.g").alias("grp")).agg(F.sum("x.s").alias("n_stored"), F.sum("x.l").alias("n_live"))


def histogram_check(df: DataFrame, old: Profile, new: Profile, n: int) -> DataFrame:
    """The old bounds (rank, w), whether each sorts before its predecessor now, and rows to the next bound as expected and now (0 at the last)."""
    placed = settled(ranks(df, old, new))
    total = placed.agg(F.max("old_rank")).first()[0] or 0
    at = sorted({1 + (i * (total - 1)) // n for i in range(n + 1)}) if total else []
    own = Window.orderBy("old_rank")  # n + 1 rows
    bounds = placed.filter(F.col("old_rank").isin(at))
    step = F.lead("new_rank").over(own) - F.col("new_rank")
    return bounds.select("old_rank", "w", F.coalesce(F.lag("new_rank").over(own) > F.col("new_rank"), F.lit(False)).alias("out_of_order"), F.coalesce(F.lead("old_rank").over(own) - F.col("old_rank"), F.lit(0)).alias("n_expected"), F.when(step > 0, step).otherwise(0).alias("n_now"))
