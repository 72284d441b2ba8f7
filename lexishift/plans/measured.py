"""Registered queries: measured names, builds, transliterations, findings, reports, and keys from a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexishift.functions import keys
from lexishift.functions.keys import PROFILES as P
from lexishift.functions.keys import Profile, key_sql, levels
from lexishift.operators import ctype as C
from lexishift.operators import elements as E
from lexishift.operators import measured as M
from lexishift.operators import rules as L
from lexishift.operators import strings
from lexishift.plans.audit import CTYPE, EDGES, NEW, NUMBER, RULES, STATE, ctype, cte, edges, query, rules, words
from lexishift.sources import corpus as S


def _weighed(name: str, p, more: tuple[tuple[str, str], ...]):
    """Keys under profile ``p`` from a table: every character of the texts and the elements ``more`` (element, what it is replaced by), as their levels weigh them."""

    def run(spark, sf):
        c = C.characters(S.table(spark, sf, "documents"), "text").select(F.col("c").alias("element"), F.col("c").alias("as"))
        lacks = c.join(spark.createDataFrame(more, "element string, as string").select("element"), "element", "left_anti")
        every = lacks.unionByName(spark.createDataFrame(more, "element string, as string"))
        bare = Profile(p.name, p.levels)
        weights = every.select("element", *[x.alias(n) for n, x in zip(("w1", "w2", "w3"), levels(F.col("as"), bare), strict=True)])
        return E.k_join(words(spark, sf), "w", weights).select("w", F.md5("key").alias("k"))

    query(name, cte(f"p as (select w, {key_sql('w', p)} as kp from words)") + " select w, md5(kp) as k from p")(run)


_weighed("f2_k_join", P["ch_new"], P["ch_new"].pre)  # contractions
_weighed("f2_expansions", P["ae"], P["ae"].pre)


def _classes(sql: str) -> str:
    return f"list_filter(string_split({sql}, ','), lambda x: x <> '')"


@query(
    "c4_ctype_changes",
    CTYPE + f"select o.cp, array_to_string(list_sort(list_filter({_classes('n.classes')}, lambda x: not list_contains({_classes('o.classes')}, x))), ',') as joins, array_to_string(list_sort(list_filter({_classes('o.classes')}, lambda x: not list_contains({_classes('n.classes')}, x))), ',') as leaves, 'changed' as state from o join n on n.cp = o.cp where o.classes <> n.classes",
)
def c4(spark, sf):
    return M.ctype_changes(ctype(spark, sf))


@query(
    "l6_byte_order",
    f"with recursive s as (select distinct source as src, {NUMBER} as n from documents), e as (select src, 'src' || ((n * 7 + 3) % 20) as dst from s where n % 5 <> 0 union select src, 'src' || ((n + 1) % 20) from s where n % 5 = 3), de as (select src as locale from s where n % 5 = 0), sg as (select src, min(dst) as dst from e where src not in (select src from s where n % 5 = 4) group by src having count(*) = 1), b(src) as (select src from sg where dst in (select locale from de) union select sg.src from sg join b on sg.dst = b.src) select locale, 'declared' as how, null as of from de union all select sg.src, 'by copy', sg.dst from sg join b on b.src = sg.src",
)
def l6(spark, sf):
    s = S.table(spark, sf, "documents").select(F.col("source").alias("src"), F.expr(NUMBER).alias("n")).distinct()
    n = F.col("n")
    to = lambda x: F.concat(F.lit("src"), (x % 20).cast("string"))
    copies = s.select("src", F.explode(F.when(n % 5 == 0, F.array()).when(n % 5 == 3, F.array(to(n * 7 + 3), to(n + 1))).otherwise(F.array(to(n * 7 + 3)))).alias("dst"))
    kind = s.withColumnRenamed("src", "locale")
    return M.byte_order(kind.filter(n % 5 == 0), copies, kind.filter(n % 5 == 4))


BUILDS = "bu as (select distinct 'old' as side, source || '.' || (doc_id % 7) as entry, source, 'c' || (doc_id % 7) as charmap from documents union select distinct 'new', source || '.' || (doc_id % 7) || case when doc_id % 7 = 3 then 'x' else '' end, source, 'c' || case when doc_id % 7 = 2 then 9 else doc_id % 7 end from documents where lang <> 'de' or doc_id % 7 <> 5 union select distinct 'old', source || e, source, 'd1' from documents, (select unnest(['.e1', '.e2', '.e3']) as e) union select distinct 'new', source || e, source, 'd2' from documents, (select unnest(['.e2', '.e3', '.e4']) as e))"


def builds(spark, sf):
    m = F.col("doc_id") % 7
    d = S.table(spark, sf, "documents")
    entry = F.concat("source", F.lit("."), m.cast("string"))
    old = d.select(F.lit("old").alias("side"), entry.alias("entry"), "source", F.concat(F.lit("c"), m.cast("string")).alias("charmap"))
    new = d.filter((F.col("lang") != "de") | (m != 5)).select(F.lit("new").alias("side"), F.concat(entry, F.when(m == 3, "x").otherwise("")).alias("entry"), "source", F.concat(F.lit("c"), F.when(m == 2, 9).otherwise(m).cast("string")).alias("charmap"))
    several = lambda side, charmap, *ends: d.select(F.lit(side).alias("side"), F.explode(F.array(*[F.concat("source", F.lit(e)) for e in ends])).alias("entry"), "source", F.lit(charmap).alias("charmap"))
    return old.unionByName(new).unionByName(several("old", "d1", ".e1", ".e2", ".e3")).unionByName(several("new", "d2", ".e2", ".e3", ".e4")).distinct()


@query(
    "l13_common_builds",
    "with " + BUILDS + ", lo as (select * from bu o where side = 'old' and not exists (select 1 from bu n where n.side = 'new' and n.source = o.source and n.charmap = o.charmap)), ln as (select * from bu n where side = 'new' and not exists (select 1 from bu o where o.side = 'old' and n.source = o.source and n.charmap = o.charmap)), pr as (select source, min(case when side = 'old' then entry end) as old_entry, min(case when side = 'new' then entry end) as new_entry, charmap as old_charmap, charmap as new_charmap from bu group by source, charmap having count(distinct side) = 2 union all select lo.source, min(lo.entry), min(lo.entry), lo.charmap, ln.charmap from lo join ln on lo.source = ln.source and lo.entry = ln.entry group by lo.source, lo.charmap, ln.charmap) select *, case when source in (select source from documents where doc_id % 3 = 0) and source not in ('src7', 'src11') then 'compared' else 'not compared' end as state from pr",
)
def l13(spark, sf):
    d = S.table(spark, sf, "documents")
    present = d.filter("doc_id % 3 = 0").select(F.lit("old").alias("side"), "source").unionByName(d.filter("source not in ('src7', 'src11')").select(F.lit("new").alias("side"), "source"))
    return M.common_builds(builds(spark, sf), present)


@query(
    "l12_unbuilt",
    f"with recursive {EDGES}, c(src, dst) as (select src, dst from e union select c.src, e.dst from c join e on c.dst = e.src), so as (select distinct source from documents), re as (select src, dst from c union select source, source from so), hi as (select distinct 'm' || (n_chars % 12) as charmap, source as file, n_chars % 50 as cp from documents), {BUILDS.replace(chr(39) + 'c' + chr(39), chr(39) + 'm' + chr(39))} select re.src as source, hi.charmap, count(distinct hi.cp) as n_chars from re join hi on hi.file = re.dst join so on so.source = re.src where hi.charmap not in ('m7', 'm8') and not exists (select 1 from bu where bu.source = re.src and bu.charmap = hi.charmap) group by 1, 2",
)
def l12(spark, sf):
    d = S.table(spark, sf, "documents")
    hits = d.select(F.concat(F.lit("m"), (F.col("n_chars") % 12).cast("string")).alias("charmap"), F.col("source").alias("file"), (F.col("n_chars") % 50).alias("cp"))
    built = builds(spark, sf).select("source", F.replace("charmap", F.lit("c"), F.lit("m")).alias("charmap"))
    return M.unbuilt_affected(edges(spark, sf), hits, built, d.select("source").distinct(), spark.createDataFrame([("m7",), ("m8",)], "charmap string"))


TRANSLIT = """with recursive ch as (select distinct lang, unicode(unnest(string_split(text, '')))::int as cp from documents),
el as (select lang as source, cp from ch where cp > 0), pt as (select distinct cp from el),
inc as (select distinct 'r_' || lang as tbl, case when lang = 'de' then 2 - t else 1 + t end as ord, 't' || t as inc from documents, (select unnest([0, 1]) as t) union all select * from (values ('t0', 1, 't2'), ('t1', 2, 't3'), ('t1', 1, 't2'), ('t3', 1, 't4'), ('t4', 7, 't1'))),
vis as (select distinct lang as source, 'r_' || lang as tbl, [0] as path, ['r_' || lang] as w, false as back from documents union all select v.source, i.inc, list_append(v.path, i.ord), list_append(v.w, i.inc), list_contains(v.w, i.inc) from vis v join inc i on i.tbl = v.tbl where not v.back),
en as (select 't' || (cp % 2) as tbl, 1 as ord, cp, 0 as alt, [cp - 32, 97] as answer from pt union all select 't' || (cp % 2), 1, cp, 1, [97 + cp % 26] from pt where cp % 4 <> 1 union all select 't' || (cp % 2), 0, cp, 0, [cp] from pt union all select 't1', 2, cp, 0, [228] from pt where cp % 3 = 0 union all select 't2', 1, cp, 0, [101] from pt where cp % 5 = 0 union all select 't4', 1, cp, 0, [102] from pt where cp % 7 = 0 union all select 'r_fr', 1, cp, 0, [103] from pt where cp % 11 = 0),
ne as (select tbl, cp, max(ord) as ord from en group by 1, 2), lv as (select en.* from en join ne using (tbl, cp, ord)),
ok as (select * from lv where {fits}),
an as (select e.source, e.cp, v.path, o.alt, array_to_string(o.answer, ' ') as answer, row_number() over (partition by e.source, e.cp order by v.path, o.alt) as r from el e join vis v on v.source = e.source and not v.back join ok o on o.tbl = v.tbl and o.cp = e.cp),
sk as (select source, min(path) as stuck from vis where back group by 1),
rs as (select e.source, e.cp, case when an.path is not null and (sk.stuck is null or an.path < sk.stuck) then 'built' when sk.stuck is not null then 'unsettled' end as state, case when an.path is not null and (sk.stuck is null or an.path < sk.stuck) then an.answer end as answer from el e left join an on an.source = e.source and an.cp = e.cp and an.r = 1 left join sk on sk.source = e.source)
"""


def _translit_sql(langs: str) -> str:
    return TRANSLIT.format(fits=_fits(langs))


def _fits(langs: str) -> str:
    return f"not exists (select 1 from (select unnest(lv.answer) as x) q where x not in (select cp from ch where lang in ({langs})))"


def resolved(spark, sf, langs):
    """Elements of each language, searched in its own table, then in what that includes: nested tables, one included twice, and one that leads back."""
    d = S.table(spark, sf, "documents").select("lang", F.explode(F.array_distinct(F.filter(F.split(F.coalesce("text", F.lit("")), ""), lambda x: x != ""))).alias("c")).select("lang", F.ascii("c").alias("cp")).filter("cp > 0").distinct()
    elements, cp = d.select(F.col("lang").alias("source"), "cp"), F.col("cp")
    points, own = elements.select("cp").distinct(), F.concat(F.lit("t"), (cp % 2).cast("string"))
    entry = lambda when, tbl, ord_, alt, *answer: F.when(when, F.struct(tbl.alias("tbl"), F.lit(ord_).alias("ord"), F.lit(alt).alias("alt"), F.array(*answer).alias("answer")))
    every = F.lit(True)
    rows = [
        entry(every, own, 1, 0, cp - 32, F.lit(97)), entry(cp % 4 != 1, own, 1, 1, 97 + cp % 26), entry(every, own, 0, 0, cp), entry(cp % 3 == 0, F.lit("t1"), 2, 0, F.lit(228)),
        entry(cp % 5 == 0, F.lit("t2"), 1, 0, F.lit(101)), entry(cp % 7 == 0, F.lit("t4"), 1, 0, F.lit(102)), entry(cp % 11 == 0, F.lit("r_fr"), 1, 0, F.lit(103)),
    ]
    entries = points.select("cp", F.explode(F.array_compact(F.array(*rows))).alias("e")).select("cp", "e.*")
    source, t = F.col("source"), F.col("t")
    roots = elements.select("source").distinct().select("source", F.concat(F.lit("r_"), "source").alias("tbl"))
    includes = roots.select("source", "tbl", F.explode(F.array(F.lit(0), F.lit(1))).alias("t")).select("tbl", F.when(source == "de", 2 - t).otherwise(1 + t).alias("ord"), F.concat(F.lit("t"), t.cast("string")).alias("inc"))
    nested = spark.createDataFrame([("t0", 1, "t2"), ("t1", 2, "t3"), ("t1", 1, "t2"), ("t3", 1, "t4"), ("t4", 7, "t1")], "tbl string, ord int, inc string")
    out = M.translit_resolve(elements, roots, includes.unionByName(nested), entries, d.filter(F.col("lang").isin(*langs)).select("cp"))
    return out.withColumn("answer", F.array_join(F.transform("answer", lambda x: x.cast("string")), " "))


@query("l14_translit_resolve", _translit_sql("'en'") + " select source, cp, state, answer from rs where state is not null")
def l14(spark, sf):
    return resolved(spark, sf, ["en"])


_both = _translit_sql("'en'").rstrip()
for _name, _new in (("ok as", "ok2 as"), ("an as", "an2 as"), ("rs as", "rs2 as")):
    _part = _both[_both.index(f"\n{_name}") + 1 :].split("\n")[0].rstrip(",")
    _part = _part.replace(_name, _new, 1).replace(_fits("'en'"), _fits("'en', 'de'")).replace("join ok o", "join ok2 o").replace("join an on", "join an2 an on")
    _both += ",\n" + _part


@query(
    "l15_translit_diff",
    _both + " select coalesce(o.source, n.source) as source, coalesce(o.cp, n.cp) as cp, case when 'unsettled' in (coalesce(o.state, ''), coalesce(n.state, '')) then 'not compared' else 'differs' end as state, o.answer as old, n.answer as new from (select * from rs where state is not null) o full join (select * from rs2 where state is not null) n on n.source = o.source and n.cp = o.cp where 'unsettled' in (coalesce(o.state, ''), coalesce(n.state, '')) or o.answer is distinct from n.answer",
)
def l15(spark, sf):
    return M.translit_diff(resolved(spark, sf, ["en"]), resolved(spark, sf, ["en", "de"]))


@query(
    "l18_rules_by_measured_name",
    RULES + ", " + STATE + f""", so as (select distinct source, {NUMBER} as nr from documents),
nm as (select distinct case doc_id % 6 when 0 then 'C' when 1 then 'POSIX' when 2 then source when 3 then source || '.UTF-8' when 4 then 'alias_' || source else lang || '_XX' end as name from documents),
al as (select 'alias_' || source as alias, source || '.utf8' as locale from so),
s2 as (select locale, state, why from st union all select 'alias_' || source, 'same', null from so where nr % 2 = 0),
ur as (select source as key, 'cut short; no rules' as why from so where nr % 7 = 3),
cm as (select source as file, min(doc_id % 4) as best from documents where {NUMBER} % 3 <> 2 group by 1),
j as (select nm.name, regexp_replace(coalesce(al.locale, nm.name), '^([^.]*)[.][^@]*', '\\1') as src from nm left join al on al.alias = nm.name),
k as (select j.*, case when j.name in (select locale from s2) then j.name else j.src end as key from j)
select k.name, case when k.name not in ('C', 'POSIX') then k.key end as key,
case when k.name in ('C', 'POSIX') then 'built in' when ur.key is not null then 'not compared' else coalesce(s2.state, 'not compared') end as state,
case when k.name in ('C', 'POSIX') then 'no locale file' when ur.key is not null then 'not read: ' || ur.why when s2.locale is not null then coalesce(s2.why, '') else 'no locale file of that name' end as why,
case when k.name in ('C', 'POSIX') then '-' else coalesce((['changed', 'transliteration', 'not compared', 'transliteration not compared'])[coalesce(c1.best, c2.best) + 1], case when k.name like '%_XX' and k.name not like 'de%' then 'not compared' else '-' end) end as charmap
from k left join s2 on s2.locale = k.key left join ur on ur.key = k.key left join cm c1 on c1.file = k.key left join cm c2 on c2.file = k.src""",
)
def l18(spark, sf):
    d, m = S.table(spark, sf, "documents"), F.col("doc_id") % 6
    name = F.when(m == 0, "C").when(m == 1, "POSIX").when(m == 2, F.col("source")).when(m == 3, F.concat("source", F.lit(".UTF-8"))).when(m == 4, F.concat(F.lit("alias_"), "source")).otherwise(F.concat("lang", F.lit("_XX")))
    so, nr = d.select("source", F.expr(NUMBER).alias("nr")).distinct(), F.col("nr")
    alias = F.concat(F.lit("alias_"), "source")
    aliases = so.select(alias.alias("alias"), F.concat("source", F.lit(".utf8")).alias("locale"))
    compared = L.compare_rules(rules(spark, sf)).unionByName(so.filter(nr % 2 == 0).select(alias.alias("locale"), F.lit("same").alias("state"), F.lit(None).cast("string").alias("why")))
    states = F.element_at(F.array(*map(F.lit, L.STATES)), (F.col("doc_id") % 4 + 1).cast("int"))
    charmaps = d.filter(F.expr(NUMBER) % 3 != 2).select(F.col("source").alias("file"), states.alias("charmap"))
    unread = so.filter(nr % 7 == 3).select(F.col("source").alias("key"), F.explode(F.array(F.lit("no rules"), F.lit("cut short"))).alias("why"))
    untraced = d.filter("lang <> 'de'").select(F.concat("lang", F.lit("_XX")).alias("name")).distinct()
    return M.rules_by_measured_name(d.select(name.alias("name")), aliases, compared, charmaps, keys.locale_source, unread, untraced)


_MEMBER = "case when f = 'lower' then {t}.lower when f = 'upper' then {t}.upper when f = 'title' then {t}.title when list_contains(string_split({t}.classes, ','), f) then 't' else 'f' end"
ASKED = ("lower", "upper", "title", "punct", "space", "alpha")


@query(
    "v6_answer_ctype",
    CTYPE + f", te as (select o.cp, f, {_MEMBER.format(t='o')} as a, {_MEMBER.format(t='n')} as b from o join n on n.cp = o.cp, (select unnest([{', '.join(repr(f) for f in ASKED)}]) as f)) select cp, f, case when cp % 7 = 0 then a else b end as answer, case when a = b then 'both' when cp % 7 = 0 then 'old' else 'new' end as \"like\" from te",
)
def v6(spark, sf):
    d = ctype(spark, sf).drop("c")
    side = lambda s: d.filter(F.col("side") == s).drop("side")
    member = F.when(F.array_contains(F.split("classes", ","), F.col("f")), "t").otherwise("f")
    case = F.when(F.col("f") == "lower", F.col("lower")).when(F.col("f") == "upper", F.col("upper")).when(F.col("f") == "title", F.col("title"))
    asked = lambda s, name: side(s).withColumn("f", F.explode(F.array(*map(F.lit, ASKED)))).select("cp", "f", F.when(F.col("f").isin(*M.CASES), case).otherwise(member).alias(name))
    tests = asked("old", "o").join(asked("new", "n"), ["cp", "f"])
    server = side("new").filter("cp % 7 <> 0").unionByName(side("old").filter("cp % 7 = 0"))
    return M.answer_ctype(tests, server)


@query(
    "o13_endpoints",
    "with c as (select distinct unicode(unnest(string_split(text, '')))::int as cp from documents), g as (select cp, cp - row_number() over (order by cp) as g from c where cp > 0), r as (select min(cp) as lo, max(cp) as hi from g group by g), x as (select lo, hi, coalesce(lead(lo) over (order by lo), 1114112) as nx, lag(hi) over (order by lo) is null as fi from r), e as (select lo as cp, 'first' as kind from x union select hi, 'last' from x union select hi + 1, 'gap first' from x where nx > hi + 1 union select nx - 1, 'gap last' from x where nx > hi + 1 union select 1, 'gap first' from x where fi and lo > 1 union select lo - 1, 'gap last' from x where fi and lo > 1 union select unnest([127, 128, 2047, 2048, 65535, 65536]), 'length') select cp::int as cp, kind from e where cp not between 55296 and 57343",
)
def o13(spark, sf):
    runs = strings.runs(C.characters(S.table(spark, sf, "documents"), "text").select(F.ascii("c").alias("cp")).filter("cp > 0"))
    return M.endpoints(runs.select(F.col("first").alias("lo"), F.col("last").alias("hi")))


@query("p3_finding_groups", "with f as (select distinct doc_id // 10 as l, lang as finding from documents), g as (select l, string_agg(finding, ',' order by finding) as s from f group by l), h as (select s, min('d' || l) as grp, count(*) as n from g group by s) select 'd' || l as locale, grp, n from g join h on h.s = g.s")
def p3(spark, sf):
    locale = F.concat(F.lit("d"), F.floor(F.col("doc_id") / 10).cast("string"))
    return M.finding_groups(S.table(spark, sf, "documents").select(locale.alias("locale"), F.col("lang").alias("finding")))


BYTES = "b as (select distinct w, encode(w) as e, octet_length(encode(w)) as n from (select unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as w from documents) where w <> '')"


@query(
    "o11_byte_runs",
    "with " + BYTES + ", v as (select n, list_reduce(list_prepend(0::hugeint, [('0x' || substring(hex(e), 2 * i - 1, 2))::hugeint for i in range(1, n + 1)]), lambda x, y: x * 256 + y) as v from b where n <= 15), g as (select n, v, v - row_number() over (partition by n order by v) as g from v) select 'bytes' as kind, n::int as len, min(v)::varchar as first, max(v)::varchar as last from g group by n, g",
)
def o11_bytes(spark, sf):
    """Runs of the words as byte strings."""
    name = F.concat(F.lit("bytes "), F.rtrim(F.regexp_replace(F.hex(F.encode("w", "utf-8")), "(..)", "$1 ")))
    found = strings.runs_of(words(spark, sf).select(strings.measured(name).alias("x")), "x")
    return found.select(F.lit("bytes").alias("kind"), F.col("first.len").alias("len"), F.col("first.value").cast("string").alias("first"), F.col("last.value").cast("string").alias("last"))


P4 = "with x as (select doc_id, n_chars, 'd' || (doc_id // 50) as locale, doc_id % 50 as seq, case when doc_id % 50 < 30 then 0 else 1 end as k, case when doc_id % 50 < 30 then 1 when doc_id % 50 < 45 then 2 else 3 end as l, case when doc_id % 50 >= 30 and doc_id % 211 = 0 then 1 else 0 end as m from documents), r as (select locale, case when doc_id % 997 = 3 then null else seq end as seq, k, l, l + m as l2, doc_id * 10 as first, case when doc_id % 331 = 5 then null else doc_id * 10 + n_chars % 12 - 1 end as last from x), ok as (select * from r where seq is not null and last is not null), t as (select locale, sum(coalesce(last - first + 1, 0) + case when first % 5000 = 70 then 1 else 0 end)::bigint as n from ok group by 1), g as (select 'd' || (doc_id // 50) as locale from documents where doc_id % 50 = 0 union all select 'd' || (doc_id // 50) from documents where doc_id % 350 = 1), v as (select 'd' || (doc_id // 50) as locale, case when max(doc_id) % 3 = 0 then 'same' else 'changed' end as verdict from documents group by 1) "


@query(
    "p4_validate",
    P4 + "select locale, 'null' as problem from r where seq is null or last is null union all select locale, 'ends of another kind or length' from ok where l <> l2 union all select locale, 'empty run' from ok where l = l2 and last < first union all select r.locale, 'run not after the one before' from ok r join ok p on p.locale = r.locale and p.seq + 1 = r.seq where (r.k, r.l, r.first) <= (p.k, p.l2, p.last) union all select t.locale, 'count differs' from t join (select locale, sum(last - first + 1) as m from ok group by 1) h on h.locale = t.locale where t.n <> h.m union all select locale, 'changed and in no group' from v where verdict = 'changed' and locale not in (select locale from g) union all select distinct locale, 'in a group and not changed' from g where locale not in (select locale from v where verdict = 'changed') union all select locale, 'in two groups' from g group by locale having count(*) > 1",
)
def p4(spark, sf):
    i, c = F.col("doc_id"), F.col("n_chars")
    d = S.table(spark, sf, "documents").withColumn("locale", F.concat(F.lit("d"), F.floor(i / 50).cast("string")))
    size = F.when(i % 50 < 30, 1).when(i % 50 < 45, 2).otherwise(3)
    text = lambda length, value: F.struct(F.when(i % 50 < 30, 0).otherwise(1).cast("tinyint").alias("kind"), length.cast("int").alias("len"), value.cast("decimal(38,0)").alias("value"))
    last = F.when(i % 331 != 5, i * 10 + c % 12 - 1)
    odd = F.when((i % 50 >= 30) & (i % 211 == 0), 1).otherwise(0)
    runs = d.select("locale", F.when(i % 997 != 3, i % 50).alias("seq"), text(size, i * 10).alias("first"), text(size + odd, last).alias("last"))
    known = d.filter((i % 997 != 3) & last.isNotNull())
    told = known.groupBy("locale").agg(F.sum(last - i * 10 + 1 + F.when(i * 10 % 5000 == 70, 1).otherwise(0)).alias("n"))
    groups = d.select(F.explode(F.array_compact(F.array(F.when(i % 50 == 0, F.col("locale")), F.when(i % 350 == 1, F.col("locale"))))).alias("locale"))
    return M.validate(runs, told, groups, d.groupBy("locale").agg(F.when(F.max("doc_id") % 3 == 0, "same").otherwise("changed").alias("verdict")))


@query(
    "p5_report",
    RULES + ", " + STATE + ", ve as (select source as locale, case when count(*) % 2 = 0 then 'changed' else 'same' end as verdict from documents group by 1), f as (select distinct source as locale, lang as finding from documents), fg as (select locale, string_agg(finding, ',' order by finding) as s from f group by locale), h as (select s, min(locale) as grp, count(*) as n from fg group by s), gr as (select locale, grp, n from fg join h on h.s = fg.s) "
    + "select ve.locale, json_object('locale', ve.locale, 'verdict', verdict, 'rules', json_object('state', coalesce(st.state, 'no rules'), 'why', coalesce(st.why, '')), 'group', json_object('state', case when gr.grp is null then 'not grouped' else 'grouped' end, 'of', coalesce(gr.grp, ''), 'n', coalesce(gr.n, 0)))::varchar as document from ve left join st on st.locale = ve.locale left join gr on gr.locale = ve.locale",
)
def p5(spark, sf):
    d = S.table(spark, sf, "documents")
    verdicts = d.groupBy(F.col("source").alias("locale")).agg(F.when(F.count("*") % 2 == 0, "changed").otherwise("same").alias("verdict"))
    return M.report(verdicts, L.compare_rules(rules(spark, sf)), M.finding_groups(d.select(F.col("source").alias("locale"), F.col("lang").alias("finding"))))
