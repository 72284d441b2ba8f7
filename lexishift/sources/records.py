"""Strict sources and sinks: catalog snapshots, answers of confirmation runs, and findings with their counts under one manifest.

Readers keep what they were given and say what is wrong with it: a file that is cut short, or states other counts than it holds, is refused or told, never read as less.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG = ("name", "encoding", "locale")


def catalog_problems(lines: DataFrame) -> DataFrame:
    """(problem, value) of the lines (value) of a catalog snapshot: rows that are not name|encoding|locale, have no name, or say one (name, encoding) twice."""
    f = F.split("value", r"\|")
    held = lines.withColumn("f", f)
    why = F.when(F.size("f") != len(CATALOG), "not three fields").when(F.trim(F.col("f")[0]) == "", "no name")
    one = held.withColumn("problem", why).filter("problem is not null").select("problem", "value")
    twice = held.filter(F.size("f") == len(CATALOG)).groupBy(F.col("f")[0].alias("a"), F.col("f")[1].alias("b")).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("told twice").alias("problem"), F.concat_ws("|", "a", "b").alias("value"))
    return one.unionByName(twice)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(name, encoding, locale) of a snapshot, an empty encoding or locale as null; a snapshot with problems is refused, with the first of them."""
    lines = spark.read.text(path).filter("value <> ''")
    bad = catalog_problems(lines).orderBy("problem", "value").first()
    if bad:
        raise ValueError(f"{path}: {bad.problem}: {bad.value}")
    return lines.select(*[F.nullif(F.split("value", r"\|")[i], F.lit("")).alias(c) for i, c in enumerate(CATALOG)])


# The records of an answer file, each with how many fields it has.
RECORDS = {"confirmation": (3,), "database encoding": (2,), "server": (2,), "collation": (3, 4), "test": (7,), "ctype": (7,), "gone": (4,), "end": (3,)}
CANNOT, USABLE = "CANNOT BE USED", "usable"


class Answers:
    """The records of answer files, a typed table each, with the ``file`` that each stands in.

    confirmation (ident, encoding), database encoding (encoding), server (version), collation (collation, usable, version), test and ctype (id, collation, answer, told, how, like),
    gone (kind, object, name), end (ident, n). Lines that are no record of these kinds are ``unknown``.
    """

    def __init__(self, lines: DataFrame, file: str = "file"):
        f = F.col("f")
        held = lines.select(F.col(file).cast("string").alias("file"), F.col("value"), F.split("value", r"\|").alias("f")).filter("value <> ''")
        size = F.size(f)
        known = F.coalesce(*[F.when(f[0] == k, size.isin(*n)) for k, n in RECORDS.items()], F.lit(False))
        number, sign = F.get(f, F.lit(1)).rlike("^[0-9]{1,18}$"), F.get(f, F.lit(3))
        good = F.when(f[0] == "test", number & sign.isin("<", ">", "=")).when(f[0] == "ctype", number & sign.rlike("^([0-9a-f]*|[tf])$"))
        good = F.coalesce(good, F.when(f[0] == "collation", F.when(size == 3, f[2] == CANNOT).otherwise((f[2] == USABLE) & F.get(f, F.lit(3)).rlike("^glibc "))), F.when(f[0] == "end", F.get(f, F.lit(2)).rlike("^[0-9]{1,18} tests?$")), F.lit(True))
        self.lines = held.withColumn("known", known & good)
        at = lambda i: F.get(f, F.lit(i))
        version = F.regexp_extract(at(3), "^glibc (.*)$", 1)
        both = {"id": at(1).cast("long"), "collation": at(2), "answer": at(3), "told": at(4), "how": at(5), "like": at(6)}
        kinds: dict[str, dict[str, Column]] = {
            "confirmation": {"ident": at(1), "encoding": at(2)}, "database encoding": {"encoding": at(1)}, "server": {"version": at(1)},
            "collation": {"collation": at(1), "usable": at(2) == USABLE, "version": F.when(version != "NULL", F.nullif(version, F.lit("")))},
            "test": both, "ctype": both, "gone": {"kind": at(1), "object": at(2), "name": at(3)}, "end": {"ident": at(1), "n": F.regexp_extract(at(2), "^([0-9]+)", 1).cast("long")},
        }
        self.tables = {k: self.lines.filter(F.col("known") & (f[0] == k)).select("file", *[c.alias(n) for n, c in columns.items()]) for k, columns in kinds.items()}
        self.unknown = self.lines.filter(~F.col("known")).select("file", "value")

    def __getitem__(self, kind: str) -> DataFrame:
        return self.tables[kind]


def read_answers(spark: SparkSession, path: str) -> Answers:
    """The answer files below ``path``."""
    return Answers(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")))


def answer_problems(answers: Answers, tests: DataFrame, encoding: str) -> DataFrame:
    """(file, problem, n) of every file: reasons why it cannot be read as whole answers to ``tests`` (collation, id) in a database of ``encoding``.

    What a file that is no such output, or comes from another encoding, lacks is not told besides: it stops there."""
    held = answers.lines
    f = F.col("f")
    kind = lambda k: F.col("known") & (f[0] == k)
    first = lambda k, i: F.max(F.when(kind(k), F.get(f, F.lit(i))))
    per = held.groupBy("file").agg(
        F.count_if(kind("confirmation")).alias("heads"), F.count_if(kind("end")).alias("ends"), first("confirmation", 1).alias("ident"), F.min(F.when(kind("end"), f[1])).alias("last"),
        first("database encoding", 1).alias("enc"), F.max(F.when(kind("end"), F.regexp_extract(f[2], "^([0-9]+)", 1).cast("long"))).alias("stated"), F.count_if(kind("test") | kind("ctype")).alias("given"), F.count_if(~F.col("known")).alias("odd"),
    )
    none, other = F.col("heads") == 0, (F.col("heads") > 0) & ~F.col("enc").eqNullSafe(F.lit(encoding))
    whole = ~none & ~other
    reasons = F.array_compact(F.array(
        F.when(none, F.struct(F.lit("is no output of a confirmation").alias("problem"), F.lit(1).cast("long").alias("n"))), F.when(other, F.struct(F.lit("comes from a database of another encoding").alias("problem"), F.lit(1).cast("long").alias("n"))),
        F.when(whole & (F.col("heads") > 1), F.struct(F.lit("holds more than one run").alias("problem"), F.col("heads").alias("n"))), F.when(whole & (F.col("ends") == 0), F.struct(F.lit("is cut short").alias("problem"), F.lit(1).cast("long").alias("n"))),
        F.when(whole & (F.col("ident") != F.col("last")), F.struct(F.lit("ends as another output").alias("problem"), F.lit(1).cast("long").alias("n"))),
        F.when(whole & (F.col("stated") != F.col("given")), F.struct(F.lit("states another number of answers").alias("problem"), F.col("stated").alias("n"))), F.when(F.col("odd") > 0, F.struct(F.lit("holds unknown lines").alias("problem"), F.col("odd").alias("n"))),
    ))
    out = per.select("file", F.explode(reasons).alias("r")).select("file", "r.*")
    files = per.filter(whole).select("file")
    told = lambda df, problem: df.groupBy("file").agg(F.count("*").alias("n")).select("file", F.lit(problem).alias("problem"), "n")
    given = answers["test"].select("file", "collation", "id").unionByName(answers["ctype"].select("file", "collation", "id")).join(files, "file", "left_semi").groupBy("file", "collation", "id").agg(F.count("*").alias("times"))
    reported = answers["collation"].join(files, "file", "left_semi").groupBy("file", "collation").agg(F.count("*").alias("times"), F.bool_and("usable").alias("usable"))
    asked, wanted = tests.select("collation", "id").distinct(), tests.select("collation").distinct()
    # a file owes the answers of the collations that it reports as usable, and a word on every other
    owed = reported.filter("usable").select("file", "collation").join(asked, "collation")
    silent = files.join(F.broadcast(wanted.agg(F.count("*").alias("_all"))), how="cross").join(reported.join(wanted, "collation", "left_semi").groupBy("file").agg(F.count("*").alias("_told")), "file", "left")  # one row beside each file
    more = [
        told(given.filter("times > 1"), "answers a test twice"), told(reported.filter("times > 1"), "reports a collation twice"), told(reported.filter("not usable"), "has collations that cannot be used"),
        told(owed.join(given, ["file", "collation", "id"], "left_anti"), "lacks answers"), told(given.join(asked, ["collation", "id"], "left_anti"), "answers what was not asked"), told(reported.join(wanted, "collation", "left_anti"), "reports collations that were not asked for"),
        silent.withColumn("n", F.col("_all") - F.coalesce("_told", F.lit(0))).filter("n > 0").select("file", F.lit("says nothing of collations").alias("problem"), "n"),
    ]
    for x in more:
        out = out.unionByName(x)
    return out


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


MANIFEST = "current.json"


def write_findings(df: DataFrame, path: str, pair: str = "pair") -> None:
    """Findings by pair and their counts, which become visible together: both are written below a name of their own, the counts from what was written, and
    one manifest, put in place by a single rename, names them. A write that fails leaves what was there before."""
    spark, run = df.sparkSession, f"run-{uuid.uuid4().hex}"
    df.write.partitionBy(pair).parquet(f"{path}/{run}/findings")
    written = spark.read.schema(df.schema).parquet(f"{path}/{run}/findings")
    written.groupBy(pair).agg(F.count("*").alias("n")).write.parquet(f"{path}/{run}/counts")
    total = spark.read.parquet(f"{path}/{run}/counts").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    jvm, target, fs = _files(spark, f"{path}/{MANIFEST}")
    temporary = jvm.org.apache.hadoop.fs.Path(f"{path}/.{run}.json")
    out = fs.create(temporary, True)
    out.write(bytearray(json.dumps({"run": run, "rows": total, "pair": pair, "schema": df.schema.simpleString()}).encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(temporary, target, options)


def read_findings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(findings, counts) that the manifest of ``path`` names; refused where there is none, or where the rows are not those it states."""
    _, target, fs = _files(spark, f"{path}/{MANIFEST}")
    if not fs.exists(target):
        raise ValueError(f"{path}: no findings have been committed")
    held = json.loads(spark.read.text(f"{path}/{MANIFEST}", wholetext=True).first()[0])
    found, counts = (spark.read.parquet(f"{path}/{held['run']}/{x}") if held["rows"] else spark.createDataFrame([], s) for x, s in (("findings", held["schema"]), ("counts", f"struct<{held['pair']}:string,n:bigint>")))
    if found.count() != held["rows"]:
        raise ValueError(f"{path}: the manifest states {held['rows']} rows, {found.count()} are there")
    return found, counts
