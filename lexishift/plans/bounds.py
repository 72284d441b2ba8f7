"""Registered queries: partitions and ranges as tables of many rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexishift.functions.keys import key, key_sql
from lexishift.operators import bounds as R
from lexishift.operators import breakage as B
from lexishift.plans.audit import DOCW, NEW, OLD, blocked, cte, query, settled, words
from lexishift.sources import corpus as S

MARK = "substring(md5(w), 1, 2)"
#: Bounds are words that a hash picks; each partition ends where the next began in the old order, and one in sixteen is left out.
BOUNDS = f"pb as (select w, lead(w) over (order by {key_sql('w', OLD)}) as hi, row_number() over (order by {key_sql('w', OLD)}) as i from words where {MARK} = '00'), bd as (select 'p' || w as part, w as lo, hi from pb where i % 16 <> 0 union all select 'first', null, min_by(w, i) from pb), bo as (select part, coalesce({key_sql('lo', OLD)}, '') as k, {key_sql('hi', OLD)} as h from bd), bn as (select part, coalesce({key_sql('lo', NEW)}, '') as k, {key_sql('hi', NEW)} as h from bd)"
PLACED = BOUNDS + ", so as (select k.w, ko, kn, case when bo.h is null or ko < bo.h then bo.part else 'none' end as part from k asof join bo on k.ko >= bo.k), sn as (select so.w, so.part, case when bn.part is null or kn >= bn.h then 'none' else bn.part end as routed from so asof left join bn on so.kn >= bn.k)"


def bounds(w):
    """The table of partitions over words ``w``, in a few hundred ranges at sf0.01."""
    from lexishift.operators.order import rank

    picked = settled(rank(w.filter(F.substring(F.md5("w"), 1, 2) == "00"), key(F.col("w"), OLD), "i"))
    after = picked.select((F.col("i") - 1).alias("i"), F.col("w").alias("hi"))
    held = picked.join(after, "i", "left").filter("i % 16 <> 0").select(F.concat(F.lit("p"), "w").alias("part"), F.col("w").alias("lo"), "hi")
    first = picked.agg(F.min_by("w", "i").alias("hi")).select(F.lit("first").alias("part"), F.lit(None).cast("string").alias("lo"), "hi")
    return settled(held.unionByName(first))


def stored(w, b):
    return settled(R.route_by(w, b, OLD).withColumnRenamed("routed", "part"))


@query("b2_many_partitions", cte(PLACED) + " select w, part, routed from sn where part <> routed")
def b2_many(spark, sf):
    w = settled(words(spark, sf))
    b = bounds(w)
    return R.misplaced_by(stored(w, b), b, NEW).select("w", "part", "routed")


@query("b3_many_partitions", cte(PLACED) + " select routed as part, count(*) as n from sn group by 1")
def b3_many(spark, sf):
    w = settled(words(spark, sf))
    return R.route_by(w, bounds(w), NEW).groupBy(F.col("routed").alias("part")).agg(F.count("*").alias("n"))


@query("b4_lookups", cte(PLACED, "q as (select distinct unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as v from benchmark)") + " select q.v, coalesce(sn.routed, case when bn.part is null or q.kn >= bn.h then 'none' else bn.part end) as routed, case when sn.w is not null and sn.part <> sn.routed then 1 else 0 end::bigint as n_lost, case when sn.w is not null then 1 else 0 end::bigint as n from (select v, " + key_sql("v", NEW) + " as kn from q) q left join sn on sn.w = q.v asof left join bn on q.kn >= bn.k")
def b4_lookups(spark, sf):
    w = settled(words(spark, sf))
    b = bounds(w)
    asked = S.words(S.table(spark, sf, "benchmark")).withColumnRenamed("w", "v")
    return R.pruning_loss(stored(w, b), b, NEW, asked)


@query("b5_many_partitions", cte(PLACED) + ", e as (select part as p, 1 as b, 0 as a, (part <> routed)::int as m from sn union all select routed, 0, 1, (part <> routed)::int from sn) select p as part, sum(b)::bigint as n_before, sum(a)::bigint as n_after, sum(a * m)::bigint as n_in, sum(b * m)::bigint as n_out from e group by p")
def b5_many(spark, sf):
    w = settled(words(spark, sf))
    b = bounds(w)
    return R.repartition_by(stored(w, b), b, NEW)[1]


RANGED = f"rw as (select distinct w from dw where {MARK} = '0a'), rg as (select w as lo, w || 'zz' as hi from rw union all select substring(w, 1, 1), w from rw), rk as (select lo, hi, {key_sql('lo', NEW)} as a, {key_sql('hi', NEW)} as b from rg), st2 as (select block, {key_sql('lo', NEW)} as l, {key_sql('hi', NEW)} as h from st), ax as (select kn, l, h from dw join st2 using (block) where kn < l or kn > h), mt as (select lo, hi, count(*) as n from rk join ax on kn >= a and kn < b and (h < a or l >= b) group by 1, 2)"


@query("b20_many_ranges", f"with {DOCW}, {RANGED} select rk.lo, rk.hi, coalesce(mt.n, 0) as n_lost from rk left join mt on mt.lo = rk.lo and mt.hi = rk.hi")
def b20_many(spark, sf):
    d = blocked(spark, sf)
    picked = settled(S.words(S.table(spark, sf, "documents")).filter(F.substring(F.md5("w"), 1, 2) == "0a"))
    ranges = picked.select(F.col("w").alias("lo"), F.concat("w", F.lit("zz")).alias("hi")).unionByName(picked.select(F.substring("w", 1, 1).alias("lo"), F.col("w").alias("hi")))
    return R.skip_losses(d, settled(B.block_stats(d, "block", OLD)), ranges, "block", NEW)
