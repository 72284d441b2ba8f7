"""Line deduplication: explode, hash, count documents per hash, drop, reassemble by position.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased. Keys of at least
``min_chars`` code points in at least ``min_docs`` documents lose their lines everywhere but in the largest
``doc_id`` that holds them. Keys are compared by two independent 64-bit hashes.

Only hashes, ids and positions are shuffled for counting; counts combine before the shuffle, so a line that
stands in a third of all documents is one row a task. The join that finds dropped positions has the hash
table of frequent lines on one side; Spark broadcasts it only under its own size threshold and splits skewed
partitions otherwise. The texts are shuffled once, to meet their dropped positions.

Defined results: a null text is one empty line; every row is a document, so rows with equal ``doc_id`` count
apart (and all keep the line if they hold the largest id); a null ``doc_id`` is less than any other; an empty
table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexishift.llm.storage import carried, materialise, restored, workspace

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWEST = -(2**63)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``_lines`` (all), ``_dropped`` (positions from 0) and ``_kept_text``."""
    spark, root = docs.sparkSession, workspace(docs.sparkSession, "lines")
    t = F.coalesce(F.col(text), F.lit(""))
    ident = [F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST)).alias("_id"), F.xxhash64(F.lit(7), t).alias("_th")]
    keyed = F.transform(F.split(t, "\n", -1), lambda line, i: F.struct(i.alias("pos"), line_key(line).alias("key")))
    long_ones = F.filter(keyed, lambda x: F.length(x["key"]) >= min_chars)
    hashed = F.transform(long_ones, lambda x: F.struct(x["pos"].alias("pos"), F.struct(F.xxhash64(F.lit(1), x["key"]).alias("a"), F.xxhash64(F.lit(2), x["key"]).alias("b")).alias("h")))
    table = materialise(docs.select(*ident, hashed.alias("marks")), f"{root}/marks")

    held = table.select("_id", F.explode(F.array_distinct(F.transform("marks", lambda x: x["h"]))).alias("h"))
    counted = held.select("_id", "h.a", "h.b").groupBy("a", "b").agg(F.count("*").alias("n"), F.max("_id").alias("keeper"))
    frequent = materialise(counted.filter(F.col("n") >= min_docs).drop("n"), f"{root}/frequent")
    marks = table.select("_id", "_th", F.explode("marks").alias("m")).select("_id", "_th", F.col("m.pos").alias("pos"), F.col("m.h.a").alias("a"), F.col("m.h.b").alias("b"))
    hits = marks.join(frequent, ["a", "b"]).filter(F.col("_id") < F.col("keeper"))
    drops = hits.groupBy("_id", "_th").agg(F.collect_set("pos").alias("_dropped"))

    own = [c for c in docs.columns if c not in ("_lines", "_dropped", "_kept_text")]
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), t.alias("_text"), *ident).join(drops, ["_id", "_th"], "left")
    out = out.withColumn("_lines", F.split("_text", "\n", -1)).withColumn("_dropped", F.coalesce("_dropped", F.array().cast("array<int>")))
    every = F.sequence(F.lit(0), F.size("_lines") - 1)
    kept = F.transform(F.array_except(every, F.col("_dropped")), lambda p: F.get(F.col("_lines"), p))
    return out.select("_row.*", "_lines", "_dropped", F.when(F.size("_dropped") == 0, F.col("_text")).otherwise(F.array_join(kept, "\n")).alias("_kept_text"))


def without_repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n_chars: str = "n_chars", **limits) -> DataFrame:
    """``docs`` with the dropped lines gone from ``text`` and ``n_chars``, where there is one, counted anew."""
    out = line_dedup(carried(docs, text=text, doc_id=doc_id), **limits)
    return restored(out, docs, **{text: F.when(F.col("text").isNotNull(), F.col("_kept_text")), n_chars: F.when(F.col("text").isNotNull(), F.length("_kept_text"))})


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select(
        "doc_id", F.size("_lines").cast("long").alias("n_lines"), F.size("_dropped").cast("long").alias("n_dropped"), F.sha2(F.col("_kept_text").cast("binary"), 256).alias("kept_sha256")
    )


ORACLE_OP5 = r"""
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select r, doc_id, unnest(ls) as line, unnest(range(len(ls))) as pos from d),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key, max(doc_id) as keeper from k where length(key) >= 40 group by key having count(distinct r) >= 5),
j as (select k.*, f.keeper is not null and k.doc_id < f.keeper as gone from k left join f on f.key = k.key)
select max(doc_id) as doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256 from j group by r"""
