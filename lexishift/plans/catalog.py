"""More registered queries: controls, chains, character classes, histograms, rule files, encodings and catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexishift.functions import keys
from lexishift.functions.keys import PROFILES as P
from lexishift.functions.keys import key, key_sql
from lexishift.operators import breakage as B
from lexishift.operators import confirm as V
from lexishift.operators import ctype as C
from lexishift.operators import order as O
from lexishift.operators import rules as L
from lexishift.plans.audit import BOUNDS, CTYPE, DBS, EDGES, NEW, NUMBER, OLD, RANKS, RULES, STATE, STORED, ctype, cte, databases, edges, lit, query, rules, settled, stored, words
from lexishift.sources import corpus as S

LOW, UP = keys.LOW + "àéèêçäöüóíñ", keys.UP + "ÀÉÈÊÇÄÖÜÓÍÑ"


@query("o3_named_pairs", f"with words as materialized (select w, substring(w, 2) as tail from (select distinct unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as w from documents)), p as materialized (select a.w as a, b.w as b from words a join words b on b.w = a.tail) select a, b, {key_sql('a', OLD)} < {key_sql('b', OLD)} as old, {key_sql('a', NEW)} < {key_sql('b', NEW)} as new from p")
def o3(spark, sf):
    w = settled(words(spark, sf))
    return O.named_pairs(w, w.select(F.col("w").alias("a"), F.expr("substring(w, 2)").alias("b")), OLD, NEW)


def _digest(name: str, p) -> str:
    return f"{name} as (select md5(string_agg(h, ',' order by b)) as d from (select (r - 1) // 1000 as b, md5(string_agg(w, ',' order by r)) as h from (select w, row_number() over (order by {key_sql('w', p)}) as r from words) group by 1))"


@query("o12_controls", cte(*[_digest(n, P[p]) for n, p in (("b", "bytes"), ("o", "vw_old"), ("n", "vw_new"), ("c", "ch_old"), ("d", "same"))], "f as (select b.d <> o.d as unlike_bytes, c.d = d.d as control_same, o.d <> n.d as moved from b, o, n, c, d)") + " select *, case when not unlike_bytes or not control_same then 'void' when moved then 'differs' else 'same' end as verdict from f")
def o12(spark, sf):
    return O.controls(settled(words(spark, sf)), OLD, NEW, (P["ch_old"], P["same"]), P["bytes"])


def _before(bound: str, p) -> str:
    return f"{key_sql('w', p)} < {lit(bound, p)}"


@query(
    "o14_chain_union",
    cte(f"m as (select w, ({_before('vz', OLD)}) <> ({_before('vz', NEW)}) as ab, ({_before('cu', NEW)}) <> ({_before('cu', P['ch_new'])}) as bc, ({_before('vz', OLD)}) <> ({_before('vz', P['ch_new'])}) as ac from words)")
    + " select w, case when (ab or bc) and ac then 'both' when ab or bc then 'only steps' else 'only whole' end as status from m where ab or bc or ac",
)
def o14(spark, sf):
    w = words(spark, sf)
    moved = lambda bound, a, b: w.filter((key(F.col("w"), a) < key(F.lit(bound), a)) != (key(F.col("w"), b) < key(F.lit(bound), b)))
    return O.chain_union(moved("vz", OLD, NEW), moved("cu", NEW, P["ch_new"]), moved("vz", OLD, P["ch_new"]))


@query("b7_class_violations", cte() + " select w from words where regexp_matches(w, '[éÉ×÷]')")
def b7(spark, sf):
    known = C.characters(S.table(spark, sf, "documents"), "text").withColumn("classes", C.char_class(F.col("c")))
    return B.class_violations(words(spark, sf), known.filter(~F.col("classes").contains("alpha") | F.col("c").isin("é", "É")))


@query("b11_stale_expression_key", cte(STORED) + f", l as (select bucket as grp, 1 as s, 0 as l from s union all select case when kn < {lit('vz', NEW)} then 'early' else 'late' end, 0, 1 from k) select grp, sum(s)::bigint as n_stored, sum(l)::bigint as n_live from l group by grp")
def b11(spark, sf):
    return B.stale_expression_key(stored(spark, sf), "bucket", keys.bucket_expr(F.col("w"), "vz", NEW))


@query(
    "b23_histogram_check",
    cte(RANKS, "t as (select count(*) as n from r), g as (select distinct 1 + (i * ((select n from t) - 1)) // 20 as p from (select unnest(range(21)) as i)), h as (select old_rank, w, lag(new_rank) over (order by old_rank) as pr, lead(new_rank) over (order by old_rank) - new_rank as st, lead(old_rank) over (order by old_rank) - old_rank as n_expected, new_rank from r where old_rank in (select p from g))")
    + " select old_rank, w, coalesce(pr > new_rank, false) as out_of_order, coalesce(n_expected, 0) as n_expected, case when st > 0 then st else 0 end as n_now from h",
)
def b23(spark, sf):
    return B.histogram_check(settled(words(spark, sf)), OLD, NEW, 20)


THREE = f"m as (select 'in ' || part as metric, 'A' as state, count(*) as v from s group by part union all select 'in ' || part, 'B', count(*) from s group by part union all select 'in ' || case when kn < {lit('vz', NEW)} then 'lo' else 'hi' end, 'C', count(*) from s group by 1 union all select 'misplaced', 'A', 0 union all select 'misplaced', 'B', count(*) from s where part <> case when kn < {lit('vz', NEW)} then 'lo' else 'hi' end union all select 'misplaced', 'C', 0)"


@query("b24_three_state", cte(STORED, THREE) + " select metric, max(v) filter (state = 'A') as \"A\", max(v) filter (state = 'B') as \"B\", max(v) filter (state = 'C') as \"C\" from m group by metric")
def b24(spark, sf):
    d = stored(spark, sf)
    fixed = B.repartition_fix(d, BOUNDS, NEW)
    out = None
    for state, rows, p in (("A", d, OLD), ("B", d, NEW), ("C", fixed, NEW)):
        per = rows.groupBy("part").agg(F.count("*").alias("value")).select(F.concat(F.lit("in "), "part").alias("metric"), "value")
        both = per.unionByName(B.misplaced(rows, BOUNDS, p).agg(F.count("*").alias("value")).select(F.lit("misplaced").alias("metric"), "value")).withColumn("state", F.lit(state))
        out = both if out is None else out.unionByName(both)
    return B.three_state(out)


@query("l5_roots", f"with recursive {EDGES}, ro as (select distinct source as root from documents where source in ('src2', 'src4', 'src9')), c(src, dst) as (select src, dst from e union select c.src, e.dst from c join e on c.dst = e.src where c.dst not in (select root from ro)) select src, dst as root from c where dst in (select root from ro)")
def l5(spark, sf):
    roots = S.table(spark, sf, "documents").filter("source in ('src2', 'src4', 'src9')").select(F.col("source").alias("root")).distinct()
    return L.nearest_roots(edges(spark, sf), roots)


@query(
    "l8_alias_expand",
    f"with n as (select distinct lang || '_' || upper(lang) as name from documents where lang in ('en', 'de')), so as (select distinct source, {NUMBER} as n, (['en', 'de', 'fr', 'es'])[{NUMBER} % 4 + 1] as l, (['en', 'de', 'fr', 'es'])[({NUMBER} + case when {NUMBER} % 5 = 0 then 1 else 0 end) % 4 + 1] as m from documents), o as (select source as name, l || '_' || upper(l) as f from so where n % 3 <> 0), w as (select source as name, m || '_' || upper(m) as f from so where n % 7 <> 0) select name, true as listed, null::varchar as why from n union all select coalesce(o.name, w.name), false, case when o.name is null then 'not compared: an alias on the new side only' when w.name is null then 'not compared: an alias on the old side only' when o.f <> w.f then 'not compared: built from another file on each side' end from o full join w on o.name = w.name where o.f in (select name from n) or w.f in (select name from n)",
)
def l8(spark, sf):
    d, name = S.table(spark, sf, "documents"), F.concat("lang", F.lit("_"), F.upper("lang"))
    so, n = d.select("source", F.expr(NUMBER).alias("n")).distinct(), F.col("n")
    code = lambda x: F.element_at(F.array(*map(F.lit, ("en", "de", "fr", "es"))), (x % 4 + 1).cast("int"))
    file = lambda x: F.concat(code(x), F.lit("_"), F.upper(code(x)), F.lit(".UTF-8")).alias("locale")
    old = so.filter(n % 3 != 0).select(F.lit("old").alias("side"), F.col("source").alias("alias"), file(n))
    new = so.filter(n % 7 != 0).select(F.lit("new").alias("side"), F.col("source").alias("alias"), file(n + F.when(n % 5 == 0, 1).otherwise(0)))
    return L.alias_expand(d.filter("lang in ('en', 'de')").select(name.alias("name")), old.unionByName(new), keys.locale_source(F.col("locale")))


@query(
    "l11_affected_builds",
    f"with recursive {EDGES}, c(src, dst) as (select src, dst from e union select c.src, e.dst from c join e on c.dst = e.src), bu as (select distinct source, lang as charmap from documents), re as (select src, dst from c union select source, source from bu), hi as (select distinct lang as charmap, source as file, n_chars % 50 as cp from documents) select bu.source, bu.charmap, count(distinct cp) as n_chars, string_agg(distinct dst, ',' order by dst) as via from bu join re on re.src = bu.source join hi on hi.file = re.dst and hi.charmap = bu.charmap group by 1, 2",
)
def l11(spark, sf):
    d = S.table(spark, sf, "documents")
    hits = d.select(F.col("lang").alias("charmap"), F.col("source").alias("file"), (F.col("n_chars") % 50).alias("cp"))
    return L.affected_builds(d.select("source", F.col("lang").alias("charmap")), edges(spark, sf), hits)


@query("l17_left_out", RULES + ", " + STATE + " select locale, state = 'not compared' as listed from st where state <> 'same'")
def l17(spark, sf):
    d = rules(spark, sf)
    once = L.inventory_diff(d.select("side", F.col("locale").alias("name")), d.select(F.lit("").alias("old"), F.lit("").alias("new")).limit(0)).select(F.col("name").alias("locale"))
    rest, listed = L.left_out(L.compare_rules(d).filter("state <> 'same'").select("locale"), once, "locale")
    return rest.withColumn("listed", F.lit(False)).unionByName(listed.withColumn("listed", F.lit(True)))


@query("l19_charmap_of", "select 'cs' || (doc_id // 2) as codeset, case when min(source) = max(source) then min(source) end as file from documents group by 1")
def l19(spark, sf):
    return L.charmap_of(S.table(spark, sf, "documents").select(F.concat(F.lit("cs"), F.floor(F.col("doc_id") / 2).cast("string")).alias("codeset"), F.col("source").alias("file")))


_CODES = ", ".join(f"({keys.quoted(c)}, {keys.quoted(e) if e else 'null'}, {keys.quoted(k)})" for c, e, k in keys.CODESETS)


@query("f10_server_encoding", f"with m(c, e, k) as (values {_CODES}), u as (select distinct upper(c) as c, e, k from m), l as (select [{', '.join(keys.quoted(c) for c, _, _ in keys.CODESETS)}] as all_), d as (select distinct case when doc_id % {len(keys.CODESETS) + 1} = 0 then lang else lower(all_[doc_id % {len(keys.CODESETS) + 1}]) end as codeset from documents, l) select codeset, e as encoding, coalesce(k, 'unknown') as class from d left join u on u.c = upper(d.codeset)")
def f10(spark, sf):
    at = (F.col("doc_id") % (len(keys.CODESETS) + 1)).cast("int")
    named = F.lower(F.try_element_at(F.array(*[F.lit(c) for c, _, _ in keys.CODESETS]), at))
    codes = S.table(spark, sf, "documents").select(F.when(at == 0, F.col("lang")).otherwise(F.when(at > 0, named)).alias("codeset")).distinct()
    return keys.server_encoding(codes, "codeset")


@query("f14_case_map", cte() + f" select w, translate(w, '{UP}', '{LOW}') as lower, translate(w, '{LOW}', '{UP}') as upper, translate(substring(w, 1, 1), '{LOW}', '{UP}') || translate(substring(w, 2), '{UP}', '{LOW}') as initcap from words")
def f14(spark, sf):
    return words(spark, sf).select("w", *[keys.case_map(F.col("w"), LOW, UP, to).alias(to) for to in ("lower", "upper", "initcap")])


@query("c1_ctype_blocks", CTYPE + ", b as (select 'old' as side, cp, lower, upper, title, classes from o union all select 'new', cp, lower, upper, title, classes from n), m as (select side, cp // 4096 as block, md5(concat_ws('|', cp, lower, upper, title, classes)) as h from b) select side, block::int as block, sum(('0x' || substring(h, 1, 16))::ubigint::hugeint)::varchar || ':' || sum(('0x' || substring(h, 17, 16))::ubigint::hugeint)::varchar as digest, count(*) as n from m group by 1, 2")
def c1(spark, sf):
    return C.ctype_blocks(ctype(spark, sf).drop("c"))


@query("v4_version_check", DBS + "select case when recorded_version is null or actual_version is null then 'unknown' when recorded_version = actual_version then 'equal' else 'differs' end as status, count(*) as n from d group by 1")
def v4(spark, sf):
    return V.version_check(databases(spark, sf), "recorded_version", "actual_version").groupBy("status").agg(F.count("*").alias("n"))


@query("p2_rules_beside", RULES + ", " + STATE + f", ve as (select coalesce(source, '') || case when doc_id % 40 = 0 then '@old' else '' end as locale, case when count(*) % 2 = 0 then 'changed' else 'same' end as verdict from documents group by 1), dx as (select distinct source as locale, 'm' as measured, case {NUMBER} % 6 when 0 then 'other' when 1 then null else 'm' end as compared from documents), j as (select ve.*, coalesce(state, 'no rules') as st, case when measured is null or compared is null then 'a digest is missing' when measured <> compared then 'the rules belong to another measurement' end as beside from ve left join st on st.locale = ve.locale left join dx on dx.locale = ve.locale) select locale, verdict, case when beside is null then st else 'refused' end as state, beside from j")
def p2(spark, sf):
    d = S.table(spark, sf, "documents")
    name = F.concat(F.coalesce("source", F.lit("")), F.when(F.col("doc_id") % 40 == 0, "@old").otherwise(""))
    verdicts = d.groupBy(name.alias("locale")).agg(F.when(F.count("*") % 2 == 0, "changed").otherwise("same").alias("verdict"))
    n = F.expr(NUMBER) % 6
    digests = d.select(F.col("source").alias("locale"), F.lit("m").alias("measured"), F.when(n == 0, "other").when(n > 1, "m").alias("compared")).distinct()
    return L.rules_beside(verdicts, L.compare_rules(rules(spark, sf)), digests)


COLL = "with co as (select doc_id, doc_id % 10 as db, case when doc_id % 4 = 0 then 'd' when doc_id % 4 = 1 then 'i' else 'c' end as provider, case when doc_id % 9 <> 0 then lang || '_' || upper(lang) end as collcollate, case when doc_id % 8 <> 0 then source end as collctype from documents), da as (select distinct doc_id % 10 as db, case when doc_id % 10 % 5 = 0 then 'i' else 'c' end as provider, case when doc_id % 10 % 3 = 0 then 'C' else 'de_DE' end as datcollate, 'en_US' as datctype from documents), j as (select co.*, case when co.provider = 'd' then da.provider else co.provider end = 'c' as libc, datcollate, datctype from co left join da on da.db = co.db) "


@query("x1_collation_halves", COLL + "select doc_id, case when libc then coalesce(case when provider = 'd' then datcollate else collcollate end, '') else '' end as sorts, case when libc then coalesce(case when provider = 'd' then datctype else collctype end, '') else '' end as chars from j")
def x1(spark, sf):
    i = F.col("doc_id")
    d = S.table(spark, sf, "documents").withColumn("db", i % 10)
    coll = d.select("doc_id", "db", F.when(i % 4 == 0, "d").when(i % 4 == 1, "i").otherwise("c").alias("provider"), F.when(i % 9 != 0, F.concat("lang", F.lit("_"), F.upper("lang"))).alias("collcollate"), F.when(i % 8 != 0, F.col("source")).alias("collctype"))
    dbs = d.select("db").distinct().select("db", F.when(F.col("db") % 5 == 0, "i").otherwise("c").alias("provider"), F.when(F.col("db") % 3 == 0, "C").otherwise("de_DE").alias("datcollate"), F.lit("en_US").alias("datctype"))
    return V.collation_halves(coll, dbs).select("doc_id", "sorts", "chars")


@query("r5_page_drift", cte(RANKS, "c as (select old_rank // 1000 as page, w, old_rank as o, new_rank as n from r where old_rank % 1000 = 0)") + " select c.page, c.w, count(*) filter (r.old_rank > c.o and r.new_rank < c.n) as n_skipped, count(*) filter (r.old_rank <= c.o and r.new_rank > c.n) as n_twice from c, r group by c.page, c.w")
def r5(spark, sf):
    return O.page_drift(settled(words(spark, sf)), 1000, OLD, NEW)
