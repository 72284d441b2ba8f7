"""Measured strings: one ordered type for code points and byte strings, and runs of them.

A string is (kind, len, value): kind 0, a code point; kind 1, ``len`` bytes read as a number. They sort by kind, then length, then value, and only strings of
one kind and length are neighbours. Byte strings of more than ``LONGEST`` bytes have no value: they stay strings of their own and are in no run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexishift.operators.order import before, bucketed

TYPE, LONGEST = "struct<kind:tinyint,len:int,value:decimal(38,0)>", 15


def measured(name: Column) -> Column:
    """The string that ``U+0057`` or ``bytes F0 AB`` names; null for what is no name, a code point beyond U+10FFFF or too many bytes."""
    digits = F.replace(F.regexp_extract(name, "^bytes ((?:[0-9A-F]{2} )*[0-9A-F]{2})$", 1), F.lit(" "), F.lit(""))
    point = F.conv(F.regexp_extract(name, "^U[+]([0-9A-F]{4,6})$", 1), 16, 10).cast("decimal(18,0)")
    whole = F.lpad(digits, 2 * LONGEST + 2, "0")
    high, low = (F.conv(F.substring(whole, at, 16), 16, 10).cast("decimal(20,0)") for at in (1, 17))
    size = (F.length(digits) / 2).cast("int")
    value = (high.cast("decimal(17,0)") * F.lit(str(2**64)).cast("decimal(20,0)")).cast("decimal(38,0)") + low
    of = lambda kind, size, value: F.struct(F.lit(kind).cast("tinyint").alias("kind"), size.cast("int").alias("len"), value.cast("decimal(38,0)").alias("value"))
    return F.when(point.isNotNull() & (point <= 0x10FFFF), of(0, F.lit(1), point)).when((size > 0) & (size <= LONGEST), of(1, size, value))


def runs_of(df: DataFrame, col: str) -> DataFrame:
    """(first, last) of the runs of consecutive strings of column ``col`` (kind, len, value); equal strings count once, nulls not.

    Strings are dealt into ranges in their order; a run that goes on over a range's end is carried on by a table of a row a range."""
    x = F.col("_x")
    held = df.select(F.col(col).cast(TYPE).alias("_x")).filter("_x.value is not null").distinct()
    cut = bucketed(held, "_x")
    own = Window.partitionBy("_bucket").orderBy("_x")
    edge = before(cut.groupBy("_bucket").agg(F.max("_x").alias("_m")), "_m", "_e", "last")
    prev = F.coalesce("_p", "_e")
    goes_on = F.coalesce((prev["kind"] == x["kind"]) & (prev["len"] == x["len"]) & (prev["value"] + 1 == x["value"]), F.lit(False))
    marked = cut.withColumn("_p", F.lag("_x").over(own)).join(edge, "_bucket").select("_bucket", "_x", F.when(~goes_on, x).alias("_s"))
    begun = before(marked.groupBy("_bucket").agg(F.max("_s").alias("_m")), "_m", "_e", "last")
    start = F.last("_s", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("_in", start).join(begun, "_bucket").groupBy(F.coalesce("_in", "_e").alias("first")).agg(F.max("_x").alias("last"))


def runs(df: DataFrame, col: str = "cp") -> DataFrame:
    """Consecutive code points as runs (first, last)."""
    named = df.select(F.struct(F.lit(0).cast("tinyint").alias("kind"), F.lit(1).alias("len"), F.col(col).cast("decimal(38,0)").alias("value")).alias("x"))
    return runs_of(named, "x").select(F.col("first.value").cast("int").alias("first"), F.col("last.value").cast("int").alias("last"))


def run_problems(runs: DataFrame) -> DataFrame:
    """(locale, seq, problem) of ``runs`` (locale, seq, first, last), strings as above: a part that is null, ends of another kind or length, a last before its first, a run not
    after the one before it (by ``seq``), and two runs of one place."""
    mixed = (F.col("first.kind") != F.col("last.kind")) | (F.col("first.len") != F.col("last.len"))
    null = F.col("locale").isNull() | F.col("seq").isNull() | F.col("first.value").isNull() | F.col("last.value").isNull() | F.col("first").isNull() | F.col("last").isNull()
    own = F.when(null, "null").when(mixed, "ends of another kind or length").when(F.col("last.value") < F.col("first.value"), "empty run")
    each = runs.select("locale", "seq", own.alias("problem")).filter("problem is not null")
    known = runs.filter(~null)
    last = known.groupBy("locale", "seq").agg(F.max("last").alias("_last"), F.count("*").alias("_n"))
    twice = last.filter("_n > 1").select("locale", "seq", F.lit("two runs of one place").alias("problem"))
    after = known.join(last.select("locale", (F.col("seq") + 1).alias("seq"), "_last"), ["locale", "seq"])
    order = after.filter(F.col("first") <= F.col("_last")).select("locale", "seq", F.lit("run not after the one before").alias("problem"))
    return each.unionByName(twice).unionByName(order.distinct())
