"""Character rules: block hashes first, details only where they differ, and the text that is exposed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexishift.operators.rules import both_sides, sum_hash

# Character classes and their patterns.
CLASSES = (("alpha", r"^\p{L}$"), ("upper", r"^\p{Lu}$"), ("lower", r"^\p{Ll}$"), ("digit", r"^[0-9]$"), ("space", r"^[ \t\n\r]$"), ("punct", r"^\p{P}$"), ("alnum", r"^[\p{L}0-9]$"), ("print", r"^[^\p{C}\t\n\r]$"), ("graph", r"^[^\p{C}\p{Z}\t\n\r]$"), ("xdigit", r"^[0-9A-Fa-f]$"))


def char_class(c: Column) -> Column:
    """the class names of a character, comma-joined."""
    return F.concat_ws(",", *[F.when(c.rlike(p), n) for n, p in CLASSES])


def characters(df: DataFrame, col: str) -> DataFrame:
    """Distinct characters of a text column."""
    return df.select(F.explode(F.array_distinct(F.filter(F.split(F.coalesce(F.col(col), F.lit("")), ""), lambda x: x != ""))).alias("c")).distinct()


# The answers that a side gives for a character, and what a change of each is called.
ANSWERS = {"lower": "other lower case", "upper": "other upper case", "title": "other title case", "classes": None}


def ctype_blocks(ctype: DataFrame, width: int = 4096) -> DataFrame:
    """(side, block, digest, n) of all answers (lower, upper, title, classes; those that the table has) of a block of code points. A null answer is told from an empty one."""
    answer = F.concat_ws("|", F.col("cp").cast("string"), *[F.coalesce(c, F.lit("\x00")) for c in ANSWERS if c in ctype.columns])
    return ctype.groupBy("side", F.floor(F.col("cp") / width).cast("int").alias("block")).agg(sum_hash(answer).alias("digest"), F.count("*").alias("n"))


def changed_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks whose digests differ, or that one side lacks."""
    return both_sides(blocks, ["block"]).filter(~(F.col("old_digest").eqNullSafe(F.col("new_digest")) & F.col("old_n").eqNullSafe(F.col("new_n")))).select("block")


def ctype_detail(ctype: DataFrame, blocks: DataFrame, width: int = 4096) -> DataFrame:
    """(cp, change): code points of changed blocks that differ, and in what; all that differs is told."""
    inside = ctype.withColumn("block", F.floor(F.col("cp") / width).cast("int")).join(blocks, "block", "left_semi").drop("block")
    d, told = both_sides(inside, ["cp"]), []
    for name, what in ANSWERS.items():
        if name in ctype.columns:
            old, new = F.col(f"old_{name}"), F.col(f"new_{name}")
            of = F.lit(what) if what else F.concat(F.coalesce(old, F.lit("none")), F.lit(" -> "), F.coalesce(new, F.lit("none")))
            told.append(F.when(~old.eqNullSafe(new), of))
    change = F.when(F.col("in_old").isNull(), "newly classified").when(F.col("in_new").isNull(), "gone").otherwise(F.concat_ws("; ", *told))
    return d.select("cp", change.alias("change")).filter("change <> ''")


def text_exposure(df: DataFrame, col: str, by: str, changed: DataFrame) -> DataFrame:
    """Per group how many rows hold a changed character."""
    hit = df.select(by, F.explode(F.array_distinct(F.filter(F.split(F.coalesce(F.col(col), F.lit("")), ""), lambda x: x != ""))).alias("c"), "_id").join(changed, "c", "left_semi")
    return hit.select(by, "_id").distinct().groupBy(by).agg(F.count("*").alias("n_rows"))


def convertible(df: DataFrame, col: str, known: DataFrame) -> DataFrame:
    """Distinct strings and whether an encoding's characters suffice for them."""
    chars = df.select(col).distinct().select(col, F.explode(F.array_distinct(F.filter(F.split(col, ""), lambda x: x != ""))).alias("c"))
    met = chars.join(known.select("c", F.lit(True).alias("_k")), "c", "left")
    return met.groupBy(col).agg(F.bool_and(F.col("_k").isNotNull()).alias("convertible"))
