"""Registered queries: files written from the given tables, read again by the strict readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexishift.plans.audit import NUMBER, query
from lexishift.sources import corpus as S
from lexishift.sources import records as R
from lexishift.sources.shared import shared_root


def _folder(spark, name: str) -> str:
    return f"{shared_root(spark)}/lexishift/{name}-{uuid.uuid4().hex}"


@query("s4_read_catalog", "select distinct lang || '_' || upper(lang) || '.' || source as name, case when doc_id % 3 = 0 then 'UTF8' when doc_id % 3 = 1 then 'LATIN1' end as encoding, case when length(source) % 2 = 0 then source end as locale from documents")
def s4(spark, sf):
    d, i = S.table(spark, sf, "documents"), F.col("doc_id")
    lines = d.select(F.concat_ws("|", F.concat("lang", F.lit("_"), F.upper("lang"), F.lit("."), "source"), F.when(i % 3 == 0, "UTF8").when(i % 3 == 1, "LATIN1").otherwise(""), F.when(F.length("source") % 2 == 0, F.col("source")).otherwise("")).alias("value")).distinct()
    path = _folder(spark, "catalog")
    lines.write.text(path)
    return R.read_catalog(spark, path)


#: Eight files of answers over all documents: 1 is cut short, 2 answers tests of each seventh document twice, 3 comes from another encoding, 4 lacks its header, 5 states a wrong number, 6 holds unknown lines and a
#: collation that cannot be used, 7 leaves out each fifth document.
S5 = f"""with d as (select doc_id, source, doc_id % 8 as file from documents), so as (select distinct source, {NUMBER} as n from documents), t as (select distinct source as collation, doc_id as id from documents),
f as (select distinct file from d), g as (select file, source, doc_id from d where not (file = 7 and doc_id % 5 = 0)),
ok as (select * from f where file not in (3, 4)),
bad as (select source from so where n % 6 = 1),
rep as (select ok.file, so.source, not (ok.file = 6 and so.n % 6 = 1) as usable from ok, so)
select file::varchar as file, 'is cut short' as problem, 1::bigint as n from f where file = 1
union all select '3', 'comes from a database of another encoding', 1 from f where file = 3
union all select '4', 'is no output of a confirmation', 1 from f where file = 4
union all select '5', 'states another number of answers', (select count(*) + 1 from g where file = 5) from f where file = 5
union all select '6', 'holds unknown lines', count(*) from d where file = 6 and doc_id % 16 = 6 having count(*) > 0
union all select '2', 'answers a test twice', count(*) from g where file = 2 and doc_id % 7 = 0 having count(*) > 0
union all select '6', 'has collations that cannot be used', count(*) from rep where not usable having count(*) > 0
union all select rep.file::varchar, 'lacks answers', count(*) from rep join t on t.collation = rep.source where rep.usable and not exists (select 1 from g where g.file = rep.file and g.doc_id = t.id and g.source = t.collation) group by 1 having count(*) > 0"""


@query("s5_read_answers", S5)
def s5(spark, sf):
    d = S.table(spark, sf, "documents").select("doc_id", "source", (F.col("doc_id") % 8).alias("file"), F.expr(NUMBER).alias("n"))
    i, file = F.col("doc_id"), F.col("file")
    line = lambda *parts: F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    test = line("test", i, F.col("source"), F.when(i % 2 == 0, "<").otherwise(">"), "old <, new >", "measured", "like the OLD machine")
    given = d.filter(~((file == 7) & (i % 5 == 0)))
    tests = given.select("file", F.explode(F.array_compact(F.array(test, F.when((file == 2) & (i % 7 == 0), test), F.when((file == 6) & (i % 16 == 6), F.concat(F.lit("noise|"), i.cast("string")))))).alias("value"))
    so, files = d.select("source", "n").distinct(), d.select("file").distinct()
    heads = files.select("file", F.explode(F.array_compact(F.array(F.when(file != 4, line("confirmation", "id7", "LATIN1")), line("database encoding", F.when(file == 3, "UTF8").otherwise("LATIN1")), line("server", "18.6")))).alias("value"))
    held = given.groupBy("file").agg((F.count("*") + F.count_if((file == 2) & (i % 7 == 0)) + F.when(F.first("file") == 5, 1).otherwise(0)).alias("stated"))
    ends = held.filter(file != 1).select("file", line("end", "id7", F.concat(F.col("stated").cast("string"), F.lit(" tests"))).alias("value"))
    word = F.when((file == 6) & (F.col("n") % 6 == 1), line("collation", F.col("source"), R.CANNOT)).otherwise(line("collation", F.col("source"), R.USABLE, "glibc 2.28"))
    told = files.crossJoin(so).select("file", word.alias("value"))  # eight files
    path = _folder(spark, "answers")
    heads.unionByName(told).unionByName(tests).unionByName(ends).write.partitionBy("file").text(path)
    answers = R.Answers(spark.read.text(path))
    return R.answer_problems(answers, d.select(F.col("source").alias("collation"), F.col("doc_id").alias("id")), "LATIN1")


@query("s6_read_rows", "select source as locale, doc_id::varchar as id, lang from documents")
def s6(spark, sf):
    d = S.table(spark, sf, "documents")
    body = d.select(F.concat_ws("\t", "source", F.col("doc_id").cast("string"), "lang").alias("value"))
    trailer = d.agg(F.concat(F.lit("# rows "), F.count("*").cast("string"), F.lit(" groups "), F.count_distinct("source").cast("string")).alias("value"))
    path = _folder(spark, "rows")
    body.unionByName(trailer).write.text(path)
    return S.read_rows_tsv(spark, path, ["locale", "id", "lang"])


@query("s7_findings", "select coalesce(source, '') || '-' || lang as pair, count(*) as n, sum(doc_id)::bigint as ids, count(*) as told from documents group by 1")
def s7(spark, sf):
    path = _folder(spark, "findings")
    found = S.table(spark, sf, "documents").select(F.concat(F.coalesce("source", F.lit("")), F.lit("-"), "lang").alias("pair"), "doc_id")
    R.write_findings(found.filter("doc_id < 0"), path)
    R.write_findings(found, path)  # takes the place of the first
    rows, counts = R.read_findings(spark, path)
    return rows.groupBy("pair").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids")).join(counts.withColumnRenamed("n", "told"), "pair")
