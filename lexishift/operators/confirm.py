"""Measured answers held against tests: likeness, completeness, verdict; catalog exposure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexishift.functions.keys import Profile, normal_name, sign


def answer_tests(tests: DataFrame, p: Profile) -> DataFrame:
    """V5: every test pair answered under a profile."""
    return tests.withColumn("answer", sign(F.col("a"), F.col("b"), p))


def likeness(answers: DataFrame) -> DataFrame:
    """V1: each answer is like the old side, the new side, both or neither."""
    o, n = F.col("answer") == F.col("o"), F.col("answer") == F.col("n")
    return answers.withColumn("like", F.when(o & n, "both").when(o, "old").when(n, "new").otherwise("neither"))


def completeness(tests: DataFrame, answers: DataFrame, on: list[str]) -> DataFrame:
    """V2: tests not answered exactly once, and answers to no test."""
    a = tests.groupBy(*on).agg(F.count("*").alias("asked"))
    b = answers.groupBy(*on).agg(F.count("*").alias("given"))
    d = a.join(b, on, "full_outer").select(*on, F.coalesce("asked", F.lit(0)).alias("asked"), F.coalesce("given", F.lit(0)).alias("given"))
    return d.filter("asked <> 1 or given <> 1").withColumn("problem", F.when(F.col("asked") == 0, "extra").when(F.col("given") == 0, "missing").otherwise("duplicate"))


def verdict(like: DataFrame) -> DataFrame:
    """V3: (n, state, reasons) of what two sides answered, from (side, like): confirmed, or refused with every reason.

    The old side must answer like old and the new side like new; answers like both tell nothing, so each side needs one that does.
    """
    count = lambda side, k: F.count_if((F.col("side") == side) & (F.col("like") == k)).alias(f"{side}_{k}")
    d = like.agg(F.count("*").alias("n"), *[count(s, k) for s in ("old", "new") for k in ("old", "new", "both", "neither")])
    c, reasons = F.col, []
    for side in ("old", "new"):
        other = "new" if side == "old" else "old"
        told, off = c(f"{side}_{side}"), c(f"{side}_{other}")
        reasons += [
            F.when(told + off + c(f"{side}_both") + c(f"{side}_neither") == 0, f"no answers of the {side} side"),
            F.when((told + off + c(f"{side}_neither") == 0) & (c(f"{side}_both") > 0), f"no answer of the {side} side tells the sides apart"),
            F.when(c(f"{side}_neither") > 0, f"the {side} side has answers like neither"),
            F.when((told > 0) & (off > 0), f"the {side} side is mixed"),
        ]
    all_off = lambda side, other: (c(f"{side}_{other}") > 0) & (c(f"{side}_{side}") == 0)
    swapped, both_old, both_new = all_off("old", "new") & all_off("new", "old"), all_off("new", "old") & ~all_off("old", "new"), all_off("old", "new") & ~all_off("new", "old")
    reasons += [F.when(swapped, "the sides are swapped"), F.when(both_old & (c("old_old") > 0), "both sides answer like old"), F.when(both_new & (c("new_new") > 0), "both sides answer like new")]
    reasons += [F.when(both_old & (c("old_old") == 0), "the new side answers like old"), F.when(both_new & (c("new_new") == 0), "the old side answers like new")]
    found = F.array_compact(F.array(*reasons))
    return d.select("n", F.when(F.size(found) == 0, "confirmed").otherwise("refused").alias("state"), F.array_join(found, "; ").alias("reasons"))


def verdict_counts(found: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Counts over a fixed list of states, zeros included. The list is a definition, so it is a literal."""
    want = found.sparkSession.createDataFrame([(d,) for d in domain], f"{column} string")
    return want.join(found.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def version_blind_spots(collations: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Recorded against actual version: mismatch, equal, both unknown. Of ``listed`` names (name) each has a row, ``not there`` where no collation (name, ...) is so called."""
    r, a = F.col("recorded_version"), F.col("actual_version")
    status = F.when(r.isNull() & a.isNull(), "both unknown").when(r.eqNullSafe(a), "equal").otherwise("mismatch")
    if listed is None:
        return collations.withColumn("status", status)
    met = listed.select("name").distinct().join(collations.withColumn("status", status), "name", "left")
    return met.withColumn("status", F.coalesce("status", F.lit("not there")))


def database_exposure(databases: DataFrame) -> DataFrame:
    """Not libc, byte order, or exposed."""
    c = F.col("datcollate")
    return databases.withColumn("verdict", F.when(F.col("provider") != "c", "not libc").when(c.isin("C", "POSIX") | c.rlike("^[Cc][.]"), "byte order").otherwise("exposed"))


def gone_names_in_use(uses: list[DataFrame], gone: DataFrame) -> DataFrame:
    """(kind, obj, value): the databases, collations and settings (each of ``uses``: kind, obj, value) that name a locale of ``gone`` (name), however its codeset is
    spelt on either side. Each use once; nulls name nothing."""
    every = reduce(DataFrame.unionByName, uses).filter("value is not null").distinct().withColumn("_n", normal_name(F.col("value")))
    return every.join(gone.select(normal_name(F.col("name")).alias("_n")).distinct(), "_n", "left_semi").select("kind", "obj", "value")


def dedup_warnings(warnings: DataFrame) -> DataFrame:
    """V7: equal warnings once, at the place of the first."""
    return warnings.groupBy("text").agg(F.min("pos").alias("pos"))


def version_check(answers: DataFrame, reported: str, expected: str) -> DataFrame:
    """V4: is the reported version the side's; what is unknown is said, and is no pass."""
    a, b = F.col(reported), F.col(expected)
    return answers.withColumn("status", F.when(a.isNull() | b.isNull(), "unknown").when(a == b, "equal").otherwise("differs"))


def collation_halves(collations: DataFrame, databases: DataFrame) -> DataFrame:
    """What each collation takes from the library: ``sorts`` and ``chars``; a default takes its database's, others than the library's give ''."""
    own = collations.join(databases.select("db", F.col("provider").alias("_p"), F.col("datcollate").alias("_s"), F.col("datctype").alias("_c")), "db", "left")
    default = F.col("provider") == "d"
    libc = F.when(default, F.col("_p")).otherwise(F.col("provider")) == "c"
    half = lambda mine, base: F.when(libc, F.coalesce(F.when(default, F.col(base)).otherwise(F.col(mine)), F.lit(""))).otherwise("")
    return own.select(*collations.columns, half("collcollate", "_s").alias("sorts"), half("collctype", "_c").alias("chars"))
