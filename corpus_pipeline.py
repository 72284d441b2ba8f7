"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, personal data, packing.

Each stage takes all rows its predecessor kept and, but for the last, returns the columns of ``documents``:

1. ``quality``: documents that the rules reject go.
2. ``lines``: repeated lines go from the texts (a document may be left with an empty text; it stays).
3. ``near_duplicates``: of each group of near copies (five-word sets with a similarity of 0.8 or more) the document with the smallest id stays.
4. ``personal_data``: confirmed spans are replaced by their kind in brackets.
5. ``packing``: pieces of the texts' ids with their sequence and offset.

SQL cannot express the near-duplicate and packing stages, so ``ORACLE_SQL`` is None; ``tests/llm`` holds the
pipeline against a brute-force version.

Defined results: a document with a null or empty text has no words, so the first stage rejects it; rows with a null ``doc_id`` go
through like others, but are never near copies; repeated rows share one id and text, so they stay or go together; other columns,
whatever their names, are carried through all stages but the last; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexishift.llm import linededup, minhash, packing, pii, quality
from lexishift.llm.storage import materialise, workspace


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.without_repeated_lines(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near_duplicates", near_stage), ("personal_data", pii_stage), ("packing", packing_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs, root = spark.read.parquet(f"{sf_dir}/documents.parquet"), workspace(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
