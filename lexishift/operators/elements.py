"""Strings cut into the elements of a table, longest first, and keys under profiles that are tables.

Every stretch of a string that has the length of some element meets the table in a join, so the table may be of any size; the longest match at each place
is kept, and a walk over these places, a batch at a time in Arrow, picks those that follow one another from the start.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType


@F.pandas_udf(ArrayType(StructType([StructField("at", IntegerType()), StructField("k", IntegerType())])))
def _walk(at: pd.Series, size: pd.Series, n: pd.Series) -> pd.Series:
    """From the first place on, (place, number of the match there or -1) one after another."""

    def one(places, sizes, end):
        match = {int(p): (k, int(s)) for k, (p, s) in enumerate(zip(places, sizes, strict=True))} if places is not None else {}
        out, p = [], 1
        while p <= end:
            k, step = match.get(p, (-1, 1))
            out.append({"at": p, "k": k})
            p += step
        return out

    return pd.Series([one(*x) for x in zip(at, size, np.asarray(n), strict=True)])


def longest_match(strings: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """(*on, _s, steps) of distinct ``strings`` (*on, _s, units) under ``table`` (*on, element, size in units, payload).

    ``steps`` are (unit, payload) in order: the elements found, and with a null payload the units that no element takes in. Empty strings have no steps.
    """
    sizes = sorted(r[0] for r in table.select("size").distinct().collect())  # how long elements are: few numbers
    lengths = F.array(*[F.lit(k) for k in sizes]) if sizes else F.array().cast("array<int>")
    places = strings.select(*on, "_s", "units", F.explode(F.sequence(F.lit(1), F.size("units"))).alias("at")).filter(F.size("units") > 0)
    tried = places.select(*on, "_s", "at", F.explode(F.filter(lengths, lambda k: F.col("at") + k - 1 <= F.size("units"))).alias("size"), "units")
    tried = tried.select(*on, "_s", "at", F.array_join(F.slice("units", F.col("at"), F.col("size")), "").alias("element"))
    met = tried.join(table.select(*on, "element", "size", "payload"), [*on, "element"])
    best = met.groupBy(*on, "_s", "at").agg(F.max_by(F.struct("size", "payload"), "size").alias("m"))
    per = best.groupBy(*on, "_s").agg(F.array_sort(F.collect_list(F.struct("at", "m"))).alias("found"))  # as many as the string has units
    key = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*on, "_s"]]
    both = strings.alias("a").join(per.alias("b"), key, "left").select(*[F.col(f"a.{c}") for c in [*on, "_s", "units"]], "found")
    walked = both.withColumn("walk", _walk(F.transform("found", lambda x: x["at"]), F.transform("found", lambda x: x["m"]["size"]), F.size("units")))
    step = lambda w: F.struct(F.element_at("units", w["at"]).alias("unit"), F.when(w["k"] >= 0, F.get("found", w["k"])["m"]["payload"]).alias("payload"))
    return walked.select(*on, "_s", F.transform("walk", step).alias("steps"))


def k_join(df: DataFrame, col: str, weights: DataFrame) -> DataFrame:
    """``df`` with ``key``, as F1 gives it, under a profile of any size: ``weights`` (element, w1, w2, w3), elements of one character or more.

    Of several elements that begin at a place the longest counts (a contraction); weights may be several characters (an expansion). A character that no element
    takes in weighs as itself; an element whose weight is null at a level is ignored there. Null strings have a null key.
    """
    levels = ["w1", "w2", "w3"]
    strings = df.select(F.col(col).alias("_s")).filter("_s is not null").distinct().withColumn("units", F.filter(F.split("_s", ""), lambda x: x != ""))
    table = weights.filter(F.length("element") > 0).select("element", F.length("element").alias("size"), F.struct(*levels).alias("payload"))
    cut = longest_match(strings, table, [])
    weigh = lambda w: F.array_join(F.transform("steps", lambda p: F.when(p["payload"].isNull(), p["unit"]).otherwise(F.coalesce(p["payload"][w], F.lit("")))), "")
    keyed = cut.select("_s", F.concat_ws("\x01", *[weigh(w) for w in levels], "_s").alias("key"))
    return df.join(keyed, F.col(col) == F.col("_s"), "left").drop("_s")
