"""Sources and sinks: words, generated corpora, code points, catalog snapshots, answers, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexishift.sources.shared import settled  # noqa: F401  (plans take it from here)

WORD = "[A-Za-zÀ-ÿ]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The stems of the generated words, the radix of each letter, and how many words share a number.
STEMS, LETTERS, PER_NUMBER = ("v", "V", "w", "W"), 26, 2704
# The seven readable words.
READABLE = ("va", "Vasa", "vind", "vz", "wa", "Wasa", "wind")


def corpus(ids: DataFrame) -> DataFrame:
    """(id, w), a distinct word for each number ``id``, by mixed-radix digits: a stem, two letters and a number of three digits or more."""
    i = F.col("id")
    letter = lambda n: F.char(97 + F.floor(i / n) % LETTERS)
    number = F.floor(i / PER_NUMBER).cast("string")
    return ids.select(i.cast("int").alias("id"), F.concat(F.element_at(F.array(*map(F.lit, STEMS)), (i % 4 + 1).cast("int")), letter(4), letter(104), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)).alias("w"))


def tokens(df: DataFrame, col: str) -> DataFrame:
    """All word tokens of a text column, with the other columns."""
    return df.withColumn("w", F.explode(F.regexp_extract_all(F.col(col), F.lit(WORD), F.lit(0)))).drop(col)


def words(df: DataFrame, col: str = "text") -> DataFrame:
    """The distinct words of a text column. A word is taken from its count's row, so that filters on keys stay above the
    aggregate: keys are built once a word, not once a token."""
    return tokens(df.select(col), col).groupBy("w").agg(F.count("*").alias("n")).select(F.when(F.col("n") > 0, F.col("w")).alias("w"))


def codepoints(spark: SparkSession) -> DataFrame:
    """S3: every code point but U+0000 and the surrogates, with its string."""
    return spark.range(1, 1114112).filter("id not between 55296 and 57343").select(F.col("id").cast("int").alias("cp"), F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "utf-32").alias("c"))


def read_rows_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated rows; ``#`` lines are comments and the trailer ``# rows N groups M`` must state how many rows and how
    many values of the first column there are (``groups M`` may be missing)."""
    lines = spark.read.text(path)
    row = ~F.col("value").startswith("#")
    body = lines.filter(row).withColumn("f", F.split("value", "\t"))
    trailer = "^# rows ([0-9]+)(?: groups ([0-9]+))?$"
    told, groups, found, wide, met = lines.agg(
        F.max(F.regexp_extract("value", trailer, 1)), F.max(F.regexp_extract("value", trailer, 2)), F.count_if(row), F.count_if(row & (F.size(F.split("value", "\t")) != len(columns))),
        F.count_distinct(F.when(row, F.split("value", "\t")[0])),
    ).first()
    if not told or int(told) != found or wide or groups and int(groups) != met:
        raise ValueError(f"{path}: the trailer states {told or 'no'} rows and {groups or 'no'} groups, {found} and {met} were read, {wide} rows of another width")
    return body.select(*[F.col("f")[i].alias(c) for i, c in enumerate(columns)])


def quarantine(df: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that pass or are not known to fail, rows that fail)."""
    good = F.coalesce(ok, F.lit(True))
    return df.filter(good), df.filter(~good)
