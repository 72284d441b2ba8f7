"""Registered queries: catalogs of many databases, derived from the documents, and what of them is exposed."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexishift.operators import exposure as E
from lexishift.plans.audit import query
from lexishift.sources import corpus as S

BASE = """with d as (select doc_id, doc_id % 10 as db, 'o' || (doc_id // 30) as obj, doc_id // 30 as k, n_chars as c, lang, source from documents),
da as (select distinct db, case when db % 5 = 0 then 'i' else 'c' end as provider, case when db % 3 = 0 then 'C' else 'de_DE' end as datcollate, case when db % 4 = 0 then 'POSIX' else 'en_US' end as datctype from d),
cn as (select distinct db, c % 12 as m from d),
co as (select db, case when m = 0 then 100 else m end as oid, 'c' || m as label, case when m = 0 then 'd' when m % 3 = 0 then 'i' else 'c' end as provider, case when m % 4 = 0 then 'C' when m <> 7 then 'sv_SE' end as collcollate, case when m % 5 = 0 then 'POSIX' else 'en_US' end as collctype from cn),
li as (select co.db, oid, label, co.provider = 'd' as is_default, coalesce(case when co.provider = 'd' then datcollate else collcollate end, '') not in ('C', 'POSIX') as sorts, coalesce(case when co.provider = 'd' then datctype else collctype end, '') not in ('C', 'POSIX') as chars from co join da on da.db = co.db where co.provider = 'c' or (co.provider = 'd' and da.provider = 'c')),
ct as (select db, 'database LC_CTYPE ' || datctype as label from da where datctype not in ('C', 'POSIX')),
ky as (select db, obj, k, case c % 13 when 0 then 0 when 12 then 100 else c % 13 end as colloid, c % 17 = 0 as extension, c % 19 = 0 as json, c % 23 = 0 as tsvector, c % 5 = 0 as expression from d),
rd as (select db, obj, case (c // 13) % 13 when 0 then 0 when 12 then 100 else (c // 13) % 13 end as colloid, source from d),
ix as (select distinct db, obj, (['hash', 'btree', 'btree', 'gin'])[k % 4 + 1] as method, k % 3 = 0 as computes, (['r', 'l', 'h'])[k % 3 + 1] as strategy from d),
se as (select distinct db, obj, source from d where lang = 'de')"""
BEST = ", b as (select db, obj, min(rank) as rank from h group by 1, 2), best as (select h.db, h.obj, h.rank, string_agg(distinct label, ', ' order by label) as labels from h join b on b.db = h.db and b.obj = h.obj and b.rank = h.rank group by 1, 2, 3)"


def frames(spark, sf):
    """(databases, library collations, keys, reads, objects, search) derived from the documents."""
    i, c = F.col("doc_id"), F.col("n_chars")
    k = F.floor(i / 30)
    d = S.table(spark, sf, "documents").select((i % 10).alias("db"), F.concat(F.lit("o"), k.cast("string")).alias("obj"), k.alias("k"), c.alias("c"), "lang", "source")
    db, m = F.col("db"), F.col("m")
    databases = d.select("db").distinct().select("db", F.when(db % 5 == 0, "i").otherwise("c").alias("provider"), F.when(db % 3 == 0, "C").otherwise("de_DE").alias("datcollate"), F.when(db % 4 == 0, "POSIX").otherwise("en_US").alias("datctype"))
    collations = d.select("db", (F.col("c") % 12).alias("m")).distinct().select(
        "db", F.when(m == 0, 100).otherwise(m).alias("oid"), F.concat(F.lit("c"), m.cast("string")).alias("label"), F.when(m == 0, "d").when(m % 3 == 0, "i").otherwise("c").alias("provider"),
        F.when(m % 4 == 0, "C").when(m != 7, "sv_SE").alias("collcollate"), F.when(m % 5 == 0, "POSIX").otherwise("en_US").alias("collctype"),
    )
    c = F.col("c")
    colloid = lambda x: F.when(x == 0, 0).when(x == 12, 100).otherwise(x).alias("colloid")
    kind = F.when(F.col("k") % 3 == 0, "r").when(F.col("k") % 3 == 1, "l").otherwise("h").alias("strategy")
    keys = d.select("db", "obj", colloid(c % 13), (c % 17 == 0).alias("extension"), (c % 19 == 0).alias("json"), (c % 23 == 0).alias("tsvector"), (c % 5 == 0).alias("expression"), kind)
    reads = d.select("db", "obj", colloid(F.floor(c / 13) % 13), "source")
    k4 = F.col("k") % 4
    objects = d.select("db", "obj", F.when(k4 == 0, "hash").when(k4 == 3, "gin").otherwise("btree").alias("method"), (F.col("k") % 3 == 0).alias("computes")).distinct()
    return databases, E.library_collations(collations, databases), keys, reads, objects, d.filter("lang = 'de'").select("db", "obj", "source").distinct()


REFS = ", refs as (select db, obj, colloid from ky where colloid <> 0 union select r.db, r.obj, r.colloid from rd r join ix on ix.db = r.db and ix.obj = r.obj where r.colloid <> 0 and ix.computes), tk as (select db, obj, bool_or(extension and colloid <> 0) as extension, bool_or(json) as json, bool_or(tsvector) as tsvector from ky group by 1, 2), x as (select ix.*, tk.extension, tk.json, tk.tsvector from ix join tk on tk.db = ix.db and tk.obj = ix.obj)"


@query(
    "x2_exposed_indexes",
    BASE + REFS
    + ", h as (select r.db, r.obj, 1 as rank, l.label from refs r join x on x.db = r.db and x.obj = r.obj join li l on l.db = r.db and l.oid = r.colloid where (l.sorts and (x.method <> 'hash' or x.computes)) or (l.chars and (x.computes or x.extension))"
    + " union select x.db, x.obj, 2, ct.label from x join ct on ct.db = x.db where x.extension or x.tsvector or (x.computes and exists (select 1 from refs r where r.db = x.db and r.obj = x.obj))"
    + " union select x.db, x.obj, 1, l.label from x join li l on l.db = x.db where l.is_default and l.sorts and x.method = 'btree' and x.json)"
    + BEST + " select db, obj, rank, labels from best",
)
def x2(spark, sf):
    databases, library, keys, reads, objects, _ = frames(spark, sf)
    return E.exposed_indexes(objects, keys, reads, library, databases)


COMPUTED = ", h as (select r.db, r.obj, 1 as rank, l.label from rd r join li l on l.db = r.db and l.oid = r.colloid where r.colloid <> 0 and (l.sorts or l.chars) union select r.db, r.obj, 2, ct.label from rd r join ct on ct.db = r.db where r.colloid <> 0"


@query("x3_exposed_checks", BASE + COMPUTED + ")" + BEST + " select db, obj, rank, labels from best")
def x3(spark, sf):
    databases, library, _, reads, _, _ = frames(spark, sf)
    return E.exposed_checks(reads, library, databases)


@query(
    "x4_exposed_partitions",
    BASE
    + ", ks as (select ky.*, ix.strategy from ky join ix on ix.db = ky.db and ix.obj = ky.obj), ex as (select db, obj, colloid from rd where colloid <> 0 union select db, obj, colloid from ky where expression and colloid <> 0)"
    + ", h as (select k.db, k.obj, 1 as rank, l.label from ks k join li l on l.db = k.db and l.oid = k.colloid where (k.strategy = 'r' and not k.expression and l.sorts) or (k.extension and l.chars)"
    + " union select k.db, k.obj, 1, l.label from ks k join li l on l.db = k.db where k.strategy = 'r' and k.json and l.is_default and l.sorts"
    + " union select e.db, e.obj, 1, l.label from ex e join li l on l.db = e.db and l.oid = e.colloid where l.sorts or l.chars"
    + " union select e.db, e.obj, 2, ct.label from ex e join ct on ct.db = e.db union select k.db, k.obj, 2, ct.label from ks k join ct on ct.db = k.db where k.extension and k.colloid <> 0)"
    + BEST + ", n as (select db, obj, count(*) as partitions from d group by 1, 2) select best.*, n.partitions from best join n on n.db = best.db and n.obj = best.obj",
)
def x4(spark, sf):
    databases, library, keys, reads, _, _ = frames(spark, sf)
    return E.exposed_partitions(keys, reads, keys, library, databases)


SEARCH = " union select s.db, s.obj, 2, ct.label from se s join ct on ct.db = s.db)"


@query("x5_exposed_generated", BASE + COMPUTED + SEARCH + BEST + " select db, obj, rank, labels from best")
def x5(spark, sf):
    databases, library, _, reads, _, search = frames(spark, sf)
    return E.exposed_generated(reads, search.select("db", "obj").distinct(), library, databases)


@query(
    "x6_exposed_matviews",
    BASE + COMPUTED + SEARCH + BEST
    + ", us as (select r.db, r.obj, 1 as rank, r.source from rd r join li l on l.db = r.db and l.oid = r.colloid where r.colloid <> 0 and (l.sorts or l.chars) union select db, obj, 2, source from rd where colloid <> 0 union select db, obj, 2, source from se)"
    + ", so as (select db, obj, rank, string_agg(distinct source, ', ' order by source) as reads_from from us group by 1, 2, 3) select best.*, coalesce(so.reads_from, '') as reads_from from best left join so on so.db = best.db and so.obj = best.obj and so.rank = best.rank",
)
def x6(spark, sf):
    databases, library, _, reads, _, search = frames(spark, sf)
    return E.exposed_matviews(reads, search, library, databases)
