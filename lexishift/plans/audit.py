"""Registered queries: an operator over the given tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexishift.functions import keys
from lexishift.functions.keys import PROFILES as P
from lexishift.functions.keys import key, key_sql, levels_sql
from lexishift.operators import breakage as B
from lexishift.operators import charmaps as M
from lexishift.operators import confirm as V
from lexishift.operators import ctype as C
from lexishift.operators import order as O
from lexishift.operators import rules as L
from lexishift.operators import strings
from lexishift.sources import corpus as S

settled = S.settled
OLD, NEW = P["vw_old"], P["vw_new"]
BOUNDS = [("lo", None, "vz"), ("hi", "vz", None)]
Q: dict[str, tuple] = {}


def query(name: str, sql: str | None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


def words(spark, sf) -> DataFrame:
    return S.words(S.table(spark, sf, "documents"))


def stored(spark, sf) -> DataFrame:
    """Words with what was written under the old rules."""
    w = words(spark, sf)
    return w.withColumn("part", B.route(F.col("w"), BOUNDS, OLD)).withColumn("bucket", keys.bucket_expr(F.col("w"), "vz", OLD)).withColumn("block", F.crc32(F.col("w").cast("binary")) % 64)


def tokens(spark, sf, name: str) -> DataFrame:
    return S.tokens(S.table(spark, sf, name).select("text"), "text")


def cte(*more: str) -> str:
    """Words and their keys in DuckDB."""
    k = f"k as (select w, {key_sql('w', OLD)} as ko, {key_sql('w', NEW)} as kn from words)"
    return "with words as (select distinct unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as w from documents), " + ", ".join([k, *more])


def lit(value: str, p) -> str:
    return key_sql(keys.quoted(value), p)


RANKS = "r as (select w, ko, kn, row_number() over (order by ko) as old_rank, row_number() over (order by kn) as new_rank from k)"
PREV = "n as (select lag(w) over (order by ko) as prev, lag(kn) over (order by ko) as pn, w, kn, ko from k)"
STORED = f"s as (select w, ko, kn, case when ko < {lit('vz', OLD)} then 'lo' else 'hi' end as part, case when ko < {lit('vz', OLD)} then 'early' else 'late' end as bucket from k)"
TOK = "select unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as w from "


@query("s1_corpus", "select doc_id::int as id, (['v', 'V', 'w', 'W'])[doc_id % 4 + 1] || chr((97 + (doc_id // 4) % 26)::int) || chr((97 + (doc_id // 104) % 26)::int) || repeat('0', greatest(0, 3 - length((doc_id // 2704)::varchar))::int) || (doc_id // 2704)::varchar as w from (select distinct doc_id from documents)")
def s1(spark, sf):
    return S.corpus(S.table(spark, sf, "documents").select(F.col("doc_id").alias("id")).distinct())


@query("s2_words", cte() + " select w from words")
def s2(spark, sf):
    return words(spark, sf)


@query("s3_codepoints", "with c as (select distinct unnest(string_split(text, '')) as c from documents) select unicode(c)::int as cp, c from c where c <> ''")
def s3(spark, sf):
    return S.codepoints(spark).join(C.characters(S.table(spark, sf, "documents"), "text"), "c").select("cp", "c")


@query("s8_quarantine", cte() + f" select w, kn < {lit('vz', NEW)} as kept from k where ko < {lit('vz', OLD)}")
def s8(spark, sf):
    good, bad = S.quarantine(words(spark, sf).filter(key(F.col("w"), OLD) < key(F.lit("vz"), OLD)), key(F.col("w"), NEW) < key(F.lit("vz"), NEW))
    return good.withColumn("kept", F.lit(True)).unionByName(bad.withColumn("kept", F.lit(False)))


def _key_query(name: str, p):
    Q[name] = (lambda spark, sf: words(spark, sf).select("w", F.md5(key(F.col("w"), p)).alias("k")), f"with words as (select distinct unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as w from documents) select w, md5({key_sql('w', p)}) as k from words")


for _name, _p in (("f1_key_vw", "vw_old"), ("f1_key_new", "vw_new"), ("f3_contraction_ch", "ch_new"), ("f4_expansion", "ae"), ("f5_ignored", "hyphen"), ("f1_key_small", "small")):
    _key_query(_name, P[_p])


@query("f3_elements", "with words as (select distinct unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as w from documents) select w, len(regexp_extract_all(w, '(?s)ch|ll|.'))::int as n from words")
def f3(spark, sf):
    return words(spark, sf).select("w", F.size(keys.elements(F.col("w"))).alias("n"))


@query("f6_byte_order", cte() + " select w, row_number() over (order by w) as rank from words")
def f6(spark, sf):
    return O.rank(settled(words(spark, sf)), key(F.col("w"), P["bytes"]))


@query("f7_sign", cte() + f" select w, case when ko < {lit('vind', OLD)} then '<' when ko > {lit('vind', OLD)} then '>' else '=' end as o, case when kn < {lit('vind', NEW)} then '<' when kn > {lit('vind', NEW)} then '>' else '=' end as n from k")
def f7(spark, sf):
    return words(spark, sf).select("w", keys.sign(F.col("w"), F.lit("vind"), OLD).alias("o"), keys.sign(F.col("w"), F.lit("vind"), NEW).alias("n"))


NAMES = "with n as (select distinct lang || '_' || upper(lang) || case when doc_id % 3 = 0 then '.UTF-8' when doc_id % 3 = 1 then '.8859-1@euro' else '' end as name from documents) "


def names(spark, sf):
    end = F.when(F.col("doc_id") % 3 == 0, ".UTF-8").when(F.col("doc_id") % 3 == 1, ".8859-1@euro").otherwise("")
    return S.table(spark, sf, "documents").select(F.concat("lang", F.lit("_"), F.upper("lang"), end).alias("name")).distinct()


@query("f8_locale_source", NAMES + r"select name, regexp_replace(name, '^([^.]*)[.][^@]*', '\1') as source from n")
def f8(spark, sf):
    return names(spark, sf).select("name", keys.locale_source(F.col("name")).alias("source"))


@query("f9_normalize_codeset", NAMES + ", b as (select name, lower(regexp_replace(regexp_extract(name, '^[^.]*[.]([^@]*)', 1), '[^A-Za-z0-9]', '', 'g')) as b from n) select name, case when regexp_matches(b, '^[0-9]+$') then 'iso' || b else b end as codeset from b")
def f9(spark, sf):
    return names(spark, sf).select("name", keys.normalize_codeset(F.col("name")).alias("codeset"))


@query("f11_string_names", "with c as (select distinct unnest(string_split(text, '')) as c from documents) select c, 'U+' || lpad(printf('%X', unicode(c)), greatest(4, len(printf('%X', unicode(c))))::int, '0') as name, true as back from c where c <> ''")
def f11(spark, sf):
    n = C.characters(S.table(spark, sf, "documents"), "text").withColumn("name", keys.string_name(F.col("c")))
    return n.withColumn("back", keys.parse_string_name(F.col("name")) == F.col("c"))


@query("f12_decode_hex", cte() + " select w, w as latin, w as utf, strlen(w)::int as n_misread from words")
def f12(spark, sf):
    hexed = lambda enc: F.hex(F.encode("w", enc))
    return words(spark, sf).select("w", keys.decode_hex(hexed("iso-8859-1"), "iso-8859-1").alias("latin"), keys.decode_hex(hexed("utf-8"), "utf-8").alias("utf"), F.length(keys.decode_hex(hexed("utf-8"), "iso-8859-1")).alias("n_misread"))


CODED = "c as (select w, case when length(w) % 5 = 0 then case when unicode(right(w, 1)) < 128 then left(w, -1) end when length(w) % 7 = 6 then null else w end as text, case when length(w) % 5 = 0 and unicode(right(w, 1)) >= 128 then 'not convertible' when length(w) % 5 <> 0 and length(w) % 7 = 6 then 'not known' else 'decoded' end as state from words)"


def coded(spark, sf, col: str = "w"):
    """Words in a multibyte encoding: one byte for ASCII, two from 8140 on for other characters; the last byte is cut off where five divides
    the length, and where it is six more than a multiple of seven the encoding is one that no map describes."""
    cp = lambda c: F.ascii(c)
    digits = F.array_join(F.transform(F.filter(F.split(col, ""), lambda c: c != ""), lambda c: F.when(cp(c) < 128, F.lpad(F.hex(cp(c)), 2, "0")).otherwise(F.lpad(F.hex(cp(c) + (0x8140 - 128)), 4, "0"))), "")
    n = F.length(col)
    return words(spark, sf).select(col, F.when(n % 5 == 0, F.substring(digits, F.lit(1), F.length(digits) - 2)).otherwise(digits).alias("h"), F.when((n % 5 != 0) & (n % 7 == 6), "other").otherwise("two").alias("encoding"))


def coding(spark, sf):
    """The map of :func:`coded`: a row for each ASCII character of the texts, and one range for all others."""
    ascii_ = C.characters(S.table(spark, sf, "documents"), "text").filter(F.ascii("c") < 128).select(F.lit("two").alias("charmap"), F.ascii("c").alias("lo"), F.ascii("c").alias("hi"), F.lpad(F.hex(F.ascii("c")), 2, "0").alias("bytes"))
    return ascii_.unionByName(spark.range(1).select(F.lit("two").alias("charmap"), F.lit(128).alias("lo"), F.lit(0x2FFF).alias("hi"), F.lit("8140").alias("bytes")))


@query("f12_by_charmap", cte(CODED) + " select w, text, state from c")
def f12_by_charmap(spark, sf):
    return M.decode_by_charmap(coded(spark, sf), "h", "encoding", coding(spark, sf)).select("w", "text", "state")


@query("v5_binary_tests", cte(CODED, f"q as (select w, text, state, {key_sql('text', NEW)} as kt from c)") + f" select w, state, case when state = 'decoded' then case when kt < {lit('vind', NEW)} then '<' when kt > {lit('vind', NEW)} then '>' else '=' end end as answer from q")
def v5_binary(spark, sf):
    tests = coded(spark, sf).select("w", F.col("h").alias("ah"), F.hex(F.encode(F.lit("vind"), "us-ascii")).alias("bh"), "encoding")
    return M.answer_binary_tests(tests, coding(spark, sf), NEW).select("w", "state", "answer")


CLASS_SQL = "concat_ws(',', " + ", ".join(f"case when regexp_matches(c, '{p}') then '{n}' end" for n, p in C.CLASSES) + ")"


@query("f13_char_class", f"with c as (select distinct unnest(string_split(text, '')) as c from documents) select c, {CLASS_SQL} as classes from c where c <> ''")
def f13(spark, sf):
    return C.characters(S.table(spark, sf, "documents"), "text").withColumn("classes", C.char_class(F.col("c")))


@query("f15_bucket", cte(STORED) + " select bucket, count(*) as n from s group by bucket")
def f15(spark, sf):
    return stored(spark, sf).groupBy("bucket").agg(F.count("*").alias("n"))


@query("f16_c_like", "select distinct name, case when name in ('C', 'POSIX') or regexp_matches(name, '^[Cc][.]') then 'byte order' else 'exposed' end as exposure from (select case doc_id % 6 when 0 then 'C' when 1 then 'POSIX' when 2 then 'c.utf8' when 3 then 'C.' || lang when 4 then 'Ca_' || lang else lang end as name from documents)")
def f16(spark, sf):
    i, lang = F.col("doc_id") % 6, F.col("lang")
    name = F.when(i == 0, "C").when(i == 1, "POSIX").when(i == 2, "c.utf8").when(i == 3, F.concat(F.lit("C."), lang)).when(i == 4, F.concat(F.lit("Ca_"), lang)).otherwise(lang)
    return S.table(spark, sf, "documents").select(name.alias("name")).distinct().withColumn("exposure", keys.is_c_like(F.col("name")))


@query("r1_range_filter", cte() + f" select w from k where ko >= {lit('va', OLD)} and ko < {lit('vz', OLD)}")
def r1(spark, sf):
    k = key(F.col("w"), OLD)
    return words(spark, sf).filter((k >= key(F.lit("va"), OLD)) & (k < key(F.lit("vz"), OLD)))


@query("r2_range_drift", cte(f"f as (select ko >= {lit('va', OLD)} and ko < {lit('vz', OLD)} as a, kn >= {lit('va', NEW)} and kn < {lit('vz', NEW)} as b from k)") + " select case when a and b then 'stay' when a then 'leave' else 'enter' end as status, count(*) as n from f where a or b group by 1")
def r2(spark, sf):
    return B.range_drift(words(spark, sf), "va", "vz", OLD, NEW)


@query("r3_order_top", cte() + " select w from k order by kn limit 100")
def r3(spark, sf):
    return B.first_rows(words(spark, sf), 100, NEW)


@query("r4_keyset_page", cte() + f" select w from k where kn > {lit('vind', NEW)} order by kn limit 100")
def r4(spark, sf):
    return B.keyset_page(words(spark, sf), "vind", 100, NEW)


@query("r6_equality", "select count(*) as n from (" + TOK + "documents) where w = 'the'")
def r6(spark, sf):
    return tokens(spark, sf, "documents").filter(F.col("w") == "the").agg(F.count("*").alias("n"))


@query("r7_count_where", cte() + f" select count(*) filter (ko < {lit('vz', OLD)}) as n_old, count(*) filter (kn < {lit('vz', NEW)}) as n_new, count(*) filter (w < 'vz') as n_bytes from k")
def r7(spark, sf):
    return words(spark, sf).agg(F.count_if(key(F.col("w"), OLD) < key(F.lit("vz"), OLD)).alias("n_old"), F.count_if(key(F.col("w"), NEW) < key(F.lit("vz"), NEW)).alias("n_new"), F.count_if(F.col("w") < "vz").alias("n_bytes"))


@query("o1_rank", cte(RANKS) + " select w, old_rank as rank from r")
def o1(spark, sf):
    return O.rank(settled(words(spark, sf)), key(F.col("w"), OLD))


@query("o2_rank_diff", cte(RANKS) + " select bool_and(old_rank = new_rank) as same, count(*) filter (old_rank <> new_rank) as n_differ, count(*) as n from r")
def o2(spark, sf):
    return O.rank_diff(settled(words(spark, sf)), OLD, NEW)


@query("o4_violations", cte(PREV) + " select prev, w from n where pn > kn")
def o4(spark, sf):
    return O.order_violations(settled(words(spark, sf)), OLD, NEW)


@query("o5_inversions", cte(RANKS, "p as (select w, old_rank, new_rank, max(new_rank) over (order by old_rank rows between unbounded preceding and 1 preceding) as hi, min(new_rank) over (order by old_rank desc rows between unbounded preceding and 1 preceding) as lo from r)") + " select w, old_rank, new_rank from p where hi > new_rank or lo < new_rank")
def o5(spark, sf):
    return O.inversion_participants(settled(words(spark, sf)), OLD, NEW).drop("witness")


def _level_sql(p, a: str, b: str) -> str:
    return "case " + " ".join(f"when {x} <> {y} then '{n}'" for n, x, y in zip(keys.LEVELS, levels_sql(a, p), levels_sql(b, p), strict=False)) + " else 'bytes only' end"


SMALL = "ws as (select distinct unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as w from documents), ks as (select w, {k} as ks from ws), n as (select lag(w) over (order by ks) as prev, w from ks)"


@query("o6_smaller", "with " + SMALL.format(k=key_sql("w", P["small"])) + f" select prev, w, {_level_sql(P['small'], 'prev', 'w')} as level from n where {_level_sql(P['small'], 'prev', 'w')} = 'smaller'")
def o6_smaller(spark, sf):
    """Neighbours that only a character which the first three levels ignore tells apart."""
    return O.told_apart(O.neighbours(settled(words(spark, sf)), P["small"]), P["small"]).filter("level = 'smaller'")


@query("o7_smaller_diff", "with " + SMALL.format(k=key_sql("w", P["small"])) + f" select prev, w, {_level_sql(P['small'], 'prev', 'w')} as old_level, {_level_sql(P['same'], 'prev', 'w')} as new_level from n where prev is not null and {_level_sql(P['small'], 'prev', 'w')} <> {_level_sql(P['same'], 'prev', 'w')}")
def o7_smaller(spark, sf):
    return O.told_apart_diff(settled(words(spark, sf)), P["small"], P["same"])


@query("o6_told_apart", cte(PREV) + f" select {_level_sql(OLD, 'prev', 'w')} as level, count(*) as n from n where prev is not null group by 1")
def o6(spark, sf):
    return O.told_apart(O.neighbours(settled(words(spark, sf)), OLD), OLD).groupBy("level").agg(F.count("*").alias("n"))


@query("o7_told_apart_diff", cte(PREV) + f" select prev, w, {_level_sql(OLD, 'prev', 'w')} as old_level, {_level_sql(NEW, 'prev', 'w')} as new_level from n where prev is not null and {_level_sql(OLD, 'prev', 'w')} <> {_level_sql(NEW, 'prev', 'w')}")
def o7(spark, sf):
    return O.told_apart_diff(settled(words(spark, sf)), OLD, NEW)


@query("o8_ties", cte(f"t as (select {levels_sql('w', OLD)[0]} as x, count(*) as n from words group by 1 having count(*) > 1)") + " select coalesce(sum(n), 0)::bigint as n_tied, count(*) as n_classes, coalesce(max(n), 0)::bigint as largest from t")
def o8(spark, sf):
    return O.ties(words(spark, sf), OLD)


@query("o9_digest", cte(RANKS, "h as (select (old_rank - 1) // 1000 as b, md5(string_agg(w, ',' order by old_rank)) as h from r group by 1)") + " select md5(string_agg(h, ',' order by b)) as digest from h")
def o9(spark, sf):
    return O.order_digest(settled(words(spark, sf)), OLD)


@query(
    "o10_witnesses",
    cte(RANKS, "p as (select w, old_rank, new_rank, max(new_rank) over u as hi, arg_max(w, new_rank) over u as hw, min(new_rank) over d as lo, arg_min(w, new_rank) over d as lw from r window u as (order by old_rank rows between unbounded preceding and 1 preceding), d as (order by old_rank desc rows between unbounded preceding and 1 preceding))", "f as (select w as a, case when hi > new_rank then hw else lw end as b, hi > new_rank as before from p where hi > new_rank or lo < new_rank)")
    + " select a, b, case when before then '>' else '<' end as o, case when before then '<' else '>' end as n, true as opposite from f",
)
def o10(spark, sf):
    found = O.inversion_participants(settled(words(spark, sf)), OLD, NEW).select(F.col("w").alias("a"), F.col("witness").alias("b"))
    return found.withColumn("o", keys.sign(F.col("a"), F.col("b"), OLD)).withColumn("n", keys.sign(F.col("a"), F.col("b"), NEW)).withColumn("opposite", F.col("o") != F.col("n"))


@query("o11_runs", "with c as (select distinct unicode(unnest(string_split(text, '')))::int as cp from documents), g as (select cp, cp - row_number() over (order by cp) as g from c where cp > 0) select min(cp) as first, max(cp) as last from g group by g")
def o11(spark, sf):
    return strings.runs(C.characters(S.table(spark, sf, "documents"), "text").select(F.ascii("c").alias("cp")))


@query("b1_partition_counts", cte(STORED) + " select part, count(*) as n from s group by part")
def b1(spark, sf):
    return stored(spark, sf).groupBy("part").agg(F.count("*").alias("n"))


@query("b2_misplaced", cte(STORED) + f" select w, part, case when kn < {lit('vz', NEW)} then 'lo' else 'hi' end as routed from s where part <> case when kn < {lit('vz', NEW)} then 'lo' else 'hi' end")
def b2(spark, sf):
    return B.misplaced(stored(spark, sf), BOUNDS, NEW).select("w", "part", "routed")


@query("b3_route", cte() + f" select case when kn < {lit('vz', NEW)} then 'lo' else 'hi' end as part, count(*) as n from k group by 1")
def b3(spark, sf):
    return words(spark, sf).groupBy(B.route(F.col("w"), BOUNDS, NEW).alias("part")).agg(F.count("*").alias("n"))


@query("b4_pruning_loss", cte(STORED) + f" select w from s where part <> case when kn < {lit('vz', NEW)} then 'lo' else 'hi' end")
def b4(spark, sf):
    d = stored(spark, sf)
    asked = d.select("w", B.route(F.col("w"), BOUNDS, NEW).alias("part"))
    return d.join(asked, ["w", "part"], "left_anti").select("w")


@query("b5_repartition_fix", cte() + f" select w, case when kn < {lit('vz', NEW)} then 'lo' else 'hi' end as part from k")
def b5(spark, sf):
    return B.repartition_fix(stored(spark, sf), BOUNDS, NEW).select("w", "part")


@query("b6_check_violations", cte() + f" select w from k where ko < {lit('vz', OLD)} and not kn < {lit('vz', NEW)}")
def b6(spark, sf):
    d = words(spark, sf).filter(key(F.col("w"), OLD) < key(F.lit("vz"), OLD))
    return B.check_violations(d, key(F.col("w"), NEW) < key(F.lit("vz"), NEW))


@query("b8_stale_columns", cte(STORED) + f" select w, bucket from s where bucket <> case when kn < {lit('vz', NEW)} then 'early' else 'late' end")
def b8(spark, sf):
    return B.stale(stored(spark, sf), "bucket", keys.bucket_expr(F.col("w"), "vz", NEW)).select("w", "bucket")


@query("b9_recompute", cte() + f" select case when kn < {lit('vz', NEW)} then 'early' else 'late' end as bucket, count(*) as n from k group by 1")
def b9(spark, sf):
    return B.recompute(stored(spark, sf), "bucket", keys.bucket_expr(F.col("w"), "vz", NEW)).groupBy("bucket").agg(F.count("*").alias("n"))


@query("b10_stale_case_key", cte() + " select w, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as o, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZÀÉÈÊÇÄÖÜÓÍÑ', 'abcdefghijklmnopqrstuvwxyzàéèêçäöüóíñ') as n from words where o <> n")
def b10(spark, sf):
    o, n = F.translate("w", keys.UP, keys.LOW), F.translate("w", keys.UP + "ÀÉÈÊÇÄÖÜÓÍÑ", keys.LOW + "àéèêçäöüóíñ")
    return words(spark, sf).select("w", o.alias("o"), n.alias("n")).filter("o <> n")


@query("b12_stale_positions", cte(RANKS) + " select w, old_rank as stored, new_rank as now from r where old_rank <> new_rank")
def b12(spark, sf):
    return B.stale_positions(settled(words(spark, sf)), OLD, NEW)


@query("b13_subset_drift", cte() + f" select ko < {lit('vz', OLD)} as stored, kn < {lit('vz', NEW)} as now, count(*) as n from k group by 1, 2")
def b13(spark, sf):
    return B.subset_drift(words(spark, sf), key(F.col("w"), OLD) < key(F.lit("vz"), OLD), key(F.col("w"), NEW) < key(F.lit("vz"), NEW))


@query("b14_duplicates", f"select w as value, count(*) as n from ({TOK} documents) group by w having count(*) > 1")
def b14(spark, sf):
    return B.duplicates(tokens(spark, sf, "documents"), F.col("w"))


@query("b15_dedup", "select text, min(doc_id) as doc_id from documents group by text")
def b15(spark, sf):
    return B.dedup_keep_first(S.table(spark, sf, "documents").select("text", "doc_id"), "text", "doc_id")


@query("b16_admit", f"with b as (select distinct w from ({TOK} benchmark)), u as (select distinct w from ({TOK} documents) where w < 'm'), p as (select distinct w from ({TOK} documents)) select b.w, case when u.w is not null or p.w is null or not b.w < 'vz' then 'REJECTED' else 'ACCEPTED' end as answer, case when u.w is not null then 'unique' when p.w is null then 'foreign key' when not b.w < 'vz' then 'check' end as why from b left join u on u.w = b.w left join p on p.w = b.w")
def b16(spark, sf):
    d = words(spark, sf)
    return B.admit(tokens(spark, sf, "benchmark").distinct(), d.filter(F.col("w") < "m"), d, F.col("w") < "vz")


@query("b17_fk_orphans", f"select w, count(*) as n from ({TOK} conversations) where w not in (select w from ({TOK} documents)) group by w")
def b17(spark, sf):
    return B.fk_orphans(tokens(spark, sf, "conversations"), words(spark, sf), "w").groupBy("w").agg(F.count("*").alias("n"))


@query("b18_fk_blocked", f"select w, count(*) as n from ({TOK} conversations) where w in (select w from ({TOK} documents)) group by w")
def b18(spark, sf):
    return B.fk_blocked_deletes(words(spark, sf), tokens(spark, sf, "conversations"), "w")


DOCW = f"dw as (select doc_id % 64 as block, w, {key_sql('w', OLD)} as ko, {key_sql('w', NEW)} as kn from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as w from documents)), st as (select block, min_by(w, ko) as lo, max_by(w, ko) as hi from dw group by block)"


def blocked(spark, sf):
    return S.tokens(S.table(spark, sf, "documents").select((F.col("doc_id") % 64).alias("block"), "text"), "text")


@query("b19_block_stats", f"with {DOCW} select block, lo, hi from st")
def b19(spark, sf):
    return B.block_stats(blocked(spark, sf), "block", OLD)


@query("b20_block_skip_loss", f"with {DOCW} select dw.block, dw.w from dw join st on st.block = dw.block where kn >= {lit('w', NEW)} and kn < {lit('wz', NEW)} and not ({key_sql('hi', NEW)} >= {lit('w', NEW)} and {key_sql('lo', NEW)} < {lit('wz', NEW)})")
def b20(spark, sf):
    d = blocked(spark, sf)
    return B.block_skip_loss(d, B.block_stats(d, "block", OLD), "block", "w", "wz", NEW).select("block", "w")


@query(
    "b21_prefix_sweep",
    f"with {DOCW}, h as (select block, substring(w, 1, 2) as prefix, count(*) as n, min(kn) as a, max(kn) as b from dw group by 1, 2), g as (select prefix, min(a) as a, max(b) as b from h group by 1), e as (select block, {key_sql('lo', NEW)} as l, {key_sql('hi', NEW)} as h from st) select prefix, sum(case when e.h < g.a or e.l > g.b then h.n else 0 end)::bigint as n_lost, sum(h.n)::bigint as n from h join g using (prefix) join e using (block) group by prefix having sum(case when e.h < g.a or e.l > g.b then h.n else 0 end) > 0",
)
def b21(spark, sf):
    d = blocked(spark, sf)
    return B.prefix_sweep(d, B.block_stats(d, "block", OLD), "block", 2, NEW)


@query("b22_histogram", cte(RANKS, "t as (select count(*) as n from r), g as (select distinct 1 + (i * ((select n from t) - 1)) // 20 as p from (select unnest(range(21)) as i))") + " select old_rank as rank, w from r where old_rank in (select p from g)")
def b22(spark, sf):
    return B.histogram(settled(words(spark, sf)), OLD, 20)


RULES = """with b as (select source as locale, doc_id as seq, lang || ' ' || (n_chars % 97) as stmt, case when doc_id % 62 = 0 and source = 'src5' then null when doc_id % 7 = 0 then [] else [n_chars % 11] end as c, doc_id % 13 = 0 as steers from documents),
rules as (select 'old' as side, * from b where locale <> 'src3' union all select 'new', locale, seq, case when seq % 31 = 0 and locale in ('src1', 'src5') then stmt || '!' else stmt end, c, steers from b where locale <> 'src4'),
dg as (select side, locale, sum(('0x' || substring(md5(seq || '|' || stmt), 1, 16))::ubigint::hugeint)::varchar || ':' || sum(('0x' || substring(md5(seq || '|' || stmt), 17, 16))::ubigint::hugeint)::varchar as d, count(*) as n from rules group by 1, 2)
"""


def rules(spark, sf):
    """Two sides of a rule table, derived from the documents' metadata."""
    b = S.table(spark, sf, "documents").select(F.col("source").alias("locale"), F.col("doc_id").alias("seq"), F.concat_ws(" ", "lang", (F.col("n_chars") % 97).cast("string")).alias("stmt"), F.when((F.col("doc_id") % 62 == 0) & (F.col("source") == "src5"), None).when(F.col("doc_id") % 7 == 0, F.array().cast("array<int>")).otherwise(F.array((F.col("n_chars") % 11).cast("int"))).alias("chars"), (F.col("doc_id") % 13 == 0).alias("steers"))
    new = b.filter("locale <> 'src4'").withColumn("stmt", F.when((F.col("seq") % 31 == 0) & F.col("locale").isin("src1", "src5"), F.concat("stmt", F.lit("!"))).otherwise(F.col("stmt")))
    return b.filter("locale <> 'src3'").withColumn("side", F.lit("old")).unionByName(new.withColumn("side", F.lit("new")))


@query("l1_rules_digest", RULES + "select side, locale, d as digest, n from dg")
def l1(spark, sf):
    return L.rules_digest(rules(spark, sf))


STATE = "st as (select coalesce(o.locale, n.locale) as locale, case when o.locale is null or n.locale is null then 'not compared' when o.d = n.d and o.n = n.n then 'same' else 'differs' end as state, case when o.locale is null then 'only on the new side' when n.locale is null then 'only on the old side' end as why from (select * from dg where side = 'old') o full join (select * from dg where side = 'new') n on o.locale = n.locale)"


@query("l2_compare_rules", RULES + ", " + STATE + " select locale, state, why from st")
def l2(spark, sf):
    return L.compare_rules(rules(spark, sf))


UNKNOWN = "the characters of a changed statement are not known"


DOUBTS = f"""dt as (select distinct case when doc_id % 2 = 0 then 'old' else 'new' end as side, source as locale, 'unsettled ' || (doc_id % 3) as why from documents where doc_id % 97 = 5),
dd as (select locale, coalesce(min(case when side = 'old' then 'old side: ' || why end), min(case when side = 'new' then 'new side: ' || why end)) as doubt from dt group by 1),
ds as (select side, locale, min(why) as doubt from dt group by 1, 2),
so as (select distinct source, {{number}} as n from documents),
al as (select 'old' as side, 'alias_' || source as alias, source as file from so where n % 4 <> 0 union all select 'new', 'alias_' || source, case when n % 6 = 0 then 'src' || ((n + 1) % 25) else source end from so where n % 5 <> 0 union all select s, 'src2', 'src9' from (select unnest(['old', 'new']) as s)),
ax as (select a.side, a.alias, a.file, dg.d, dg.n, ds.doubt from (select * from al where alias not in (select locale from st)) a left join dg on dg.side = a.side and dg.locale = a.file left join ds on ds.side = a.side and ds.locale = a.file),
aj as (select coalesce(o.alias, n.alias) as locale, case when o.alias is null then 'an alias on the new side only' when n.alias is null then 'an alias on the old side only' when o.d is null then 'built from ' || o.file || ', which has no rules on the old side' when n.d is null then 'built from ' || n.file || ', which has no rules on the new side' when o.doubt is not null then 'old side: ' || o.doubt when n.doubt is not null then 'new side: ' || n.doubt end as why, o.d = n.d and o.n = n.n as alike from (select * from ax where side = 'old') o full join (select * from ax where side = 'new') n on o.alias = n.alias where o.d is not null or n.d is not null)"""


def _doubts(number: str) -> str:
    return DOUBTS.replace("{number}", number)


@query("l3_changed_chars", RULES + f", ch as (select locale, stmt from rules group by 1, 2 having sum(case when side = 'old' then 1 else -1 end) <> 0) select r.locale, bool_or(steers) as every_rule, case when not bool_or(c is null) then coalesce(array_to_string(list_sort(list_distinct(flatten(list(c) filter (c is not null)))::varchar[]), ','), '') end as chars, case when bool_or(c is null) then '{UNKNOWN}' end as why from rules r join ch on ch.locale = r.locale and ch.stmt = r.stmt group by r.locale")
def l3(spark, sf):
    out = L.changed_chars(rules(spark, sf))
    return out.select("locale", "every_rule", F.array_join(F.array_sort(F.transform("chars", lambda c: c.cast("string"))), ",").alias("chars"), "why")


NUMBER = "coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) as int), length(source))"


@query("l2_doubts_and_aliases", RULES + ", " + STATE + ", " + _doubts(NUMBER) + " select st.locale, case when coalesce(st.why, dd.doubt) is not null then 'not compared' else st.state end as state, coalesce(st.why, dd.doubt) as why from st left join dd on dd.locale = st.locale union all select locale, case when why is not null then 'not compared' when alike then 'same' else 'differs' end, why from aj")
def l2_doubts(spark, sf):
    d = S.table(spark, sf, "documents")
    i = F.col("doc_id")
    doubts = d.filter(i % 97 == 5).select(F.when(i % 2 == 0, "old").otherwise("new").alias("side"), F.col("source").alias("locale"), F.concat(F.lit("unsettled "), (i % 3).cast("string")).alias("why"))
    so, n = d.select("source", F.expr(NUMBER).alias("n")).distinct(), F.col("n")
    alias = F.concat(F.lit("alias_"), "source").alias("alias")
    utf = lambda c: F.concat(c, F.lit(".UTF-8")).alias("locale")
    old = so.filter(n % 4 != 0).select(F.lit("old").alias("side"), alias, utf(F.col("source")))
    new = so.filter(n % 5 != 0).select(F.lit("new").alias("side"), alias, utf(F.when(n % 6 == 0, F.concat(F.lit("src"), ((n + 1) % 25).cast("string"))).otherwise(F.col("source"))))
    named = so.filter("source = 'src2'").select(F.explode(F.array(F.lit("old"), F.lit("new"))).alias("side"), F.lit("src2").alias("alias"), F.lit("src9").alias("locale"))
    return L.compare_rules(rules(spark, sf), doubts, old.unionByName(new).unionByName(named), lambda c: keys.locale_source(F.col(c)))


EDGES = f"e as (select distinct source as src, 'src' || (({NUMBER} * 7 + 3) % 20) as dst from documents)"


def edges(spark, sf):
    """A copy graph over all sources of the documents."""
    return S.table(spark, sf, "documents").select(F.col("source").alias("src"), F.concat(F.lit("src"), ((F.expr(NUMBER) * 7 + 3) % 20).cast("string")).alias("dst")).distinct()


@query("l4_closure", f"with recursive {EDGES}, c(src, dst) as (select src, dst from e union select c.src, e.dst from c join e on c.dst = e.src) select src, dst from c")
def l4(spark, sf):
    return L.closure(edges(spark, sf))


@query("l7_inventory", RULES + "select coalesce(o.locale, n.locale) as name, case when o.locale is null then 'added' when o.locale = 'src4' then 'renamed to src3' else 'removed' end as status from (select distinct locale from rules where side = 'old') o full join (select distinct locale from rules where side = 'new') n on o.locale = n.locale where o.locale is null or n.locale is null")
def l7(spark, sf):
    d = rules(spark, sf)
    moved = d.filter("locale = 'src4'").select(F.col("locale").alias("old"), F.lit("src3").alias("new")).distinct()
    return L.inventory_diff(d.select("side", F.col("locale").alias("name")), moved)


CHARMAP = """with ch as (select distinct lang, unicode(unnest(string_split(text, '')))::int as cp, doc_id % 2 as h from documents),
sg as (select distinct case when h = 0 then 'old' else 'new' end as side, lang as charmap, cp, printf('%02X', cp % 256) as bytes from ch where cp > 0),
rg as (select case when doc_id % 2 = 0 then 'old' else 'new' end as side, lang as charmap, 20000 + (doc_id % 97) * 50 as lo, max(n_chars % 40) as k, min(33088 + (doc_id % 97) * 50 + case when doc_id % 5 = 0 then 1 else 0 end) as v from documents group by 1, 2, 3),
rm as (select side, charmap, (lo + i)::int as cp, printf('%04X', v + i) as bytes from (select *, unnest(range(0, k + 1)) as i from rg)),
m as (select * from sg union all select rm.* from rm where not exists (select 1 from sg where sg.side = rm.side and sg.charmap = rm.charmap and sg.cp = rm.cp)),
dl as (select coalesce(o.charmap, n.charmap) as charmap, coalesce(o.cp, n.cp) as cp, case when o.cp is null then 'added' when n.cp is null then 'removed' else 'other bytes' end as change
  from (select * from m where side = 'old') o full join (select * from m where side = 'new') n on o.charmap = n.charmap and o.cp = n.cp where o.bytes is distinct from n.bytes)
"""


def charmap(spark, sf):
    """Two sides of character maps: a row for each character of the texts, and ranges of up to 40 code points."""
    d = S.table(spark, sf, "documents")
    i, side = F.col("doc_id"), F.when(F.col("doc_id") % 2 == 0, "old").otherwise("new").alias("side")
    chars = d.select(side, F.col("lang").alias("charmap"), F.explode(F.array_distinct(F.filter(F.split(F.coalesce("text", F.lit("")), ""), lambda x: x != ""))).alias("c")).distinct()
    singles = chars.select("side", "charmap", F.ascii("c").alias("lo"), F.ascii("c").alias("hi"), F.lpad(F.hex(F.ascii("c") % 256), 2, "0").alias("bytes"))
    held = d.groupBy(side, F.col("lang").alias("charmap"), (i % 97 * 50 + 20000).cast("int").alias("lo")).agg(F.max(F.col("n_chars") % 40).alias("k"), F.min(i % 97 * 50 + 33088 + F.when(i % 5 == 0, 1).otherwise(0)).alias("v"))
    return singles.unionByName(held.select("side", "charmap", "lo", (F.col("lo") + F.col("k")).cast("int").alias("hi"), F.lpad(F.hex("v"), 4, "0").alias("bytes")))


@query("l9_charmap_delta", CHARMAP + "select charmap, cp, change from dl")
def l9(spark, sf):
    return M.charmap_delta(charmap(spark, sf))


@query("l10_delta_hits", CHARMAP + ", r as (select distinct source as name, (n_chars % 200)::int as lo, (n_chars % 200 + 40)::int as hi from documents) select distinct r.name, dl.cp from r join dl on dl.cp between r.lo and r.hi")
def l10(spark, sf):
    lo = (F.col("n_chars") % 200).cast("int")
    return L.delta_hits(M.charmap_delta(charmap(spark, sf)), S.table(spark, sf, "documents").select(F.col("source").alias("name"), lo.alias("lo"), (lo + 40).alias("hi")).distinct())


@query("l16_strongest", "select source, min_by(s, r) as state from (select source, case doc_id % 4 when 0 then 'changed' when 1 then 'transliteration' when 2 then 'not compared' else 'transliteration not compared' end as s, doc_id % 4 as r from documents) group by source")
def l16(spark, sf):
    k = F.col("doc_id") % 4
    return L.strongest_state(S.table(spark, sf, "documents").select("source", F.when(k == 0, "changed").when(k == 1, "transliteration").when(k == 2, "not compared").otherwise("transliteration not compared").alias("state")))


@query("l20_group_alike", RULES + ", " + STATE + " select st.state, st.locale, g.grp, g.n from st join (select state, min(locale) as grp, count(*) as n from st group by 1) g on g.state = st.state")
def l20(spark, sf):
    return L.group_alike(L.compare_rules(rules(spark, sf)), ["state"], "locale")


CTYPE = f"""with ch as (select distinct unnest(string_split(text, '')) as c from documents), o as (select unicode(c)::int as cp, c, translate(c, '{keys.UP}', '{keys.LOW}') as lower, translate(c, '{keys.LOW}', '{keys.UP}') as upper, translate(c, '{keys.LOW}', '{keys.UP}') as title, {CLASS_SQL} as classes from ch where c <> ''),
n as (select cp, c, case when c = 'É' then 'é' else lower end as lower, case when c in ('é', 'ü') then case c when 'é' then 'É' else 'Ü' end else upper end as upper, case when c = 'ß' then 'Ss' else title end as title, case when classes = 'punct,print,graph' and c in ('.', '-') then 'space' else classes end as classes from o),
df as (select o.cp, o.c, concat_ws('; ', case when o.lower <> n.lower then 'other lower case' end, case when o.upper <> n.upper then 'other upper case' end, case when o.title <> n.title then 'other title case' end, case when o.classes <> n.classes then o.classes || ' -> ' || n.classes end) as change from o join n on n.cp = o.cp where o.lower <> n.lower or o.upper <> n.upper or o.title <> n.title or o.classes <> n.classes)
"""


def ctype(spark, sf):
    c = F.col("c")
    upper = F.translate("c", keys.LOW, keys.UP)
    o = C.characters(S.table(spark, sf, "documents"), "text").select(F.ascii("c").alias("cp"), "c", F.translate("c", keys.UP, keys.LOW).alias("lower"), upper.alias("upper"), upper.alias("title"), C.char_class(c).alias("classes"))
    n = o.withColumn("lower", F.when(c == "É", "é").otherwise(F.col("lower"))).withColumn("upper", F.when(c == "é", "É").when(c == "ü", "Ü").otherwise(F.col("upper"))).withColumn("title", F.when(c == "ß", "Ss").otherwise(F.col("title")))
    n = n.withColumn("classes", F.when((F.col("classes") == "punct,print,graph") & c.isin(".", "-"), "space").otherwise(F.col("classes")))
    return o.withColumn("side", F.lit("old")).unionByName(n.withColumn("side", F.lit("new")))


@query("c2_changed_blocks", CTYPE + "select distinct cp // 4096 as block from df")
def c2(spark, sf):
    return C.changed_blocks(C.ctype_blocks(ctype(spark, sf).drop("c")))


@query("c3_ctype_detail", CTYPE + "select cp, change from df")
def c3(spark, sf):
    d = ctype(spark, sf).drop("c")
    return C.ctype_detail(d, C.changed_blocks(C.ctype_blocks(d)))


@query("c5_text_exposure", CTYPE + ", x as (select lang, doc_id, unnest(string_split(text, '')) as c from documents) select lang, count(distinct doc_id) as n_rows from x where c in (select c from df) group by lang")
def c5(spark, sf):
    d = ctype(spark, sf)
    plain = d.drop("c")
    changed = C.ctype_detail(plain, C.changed_blocks(C.ctype_blocks(plain))).join(d.select("cp", "c").distinct(), "cp").select("c")
    return C.text_exposure(S.table(spark, sf, "documents").withColumn("_id", F.col("doc_id")), "text", "lang", changed)


@query("c6_convertible", cte() + ", known as (select distinct unnest(string_split(text, '')) as c from documents where lang = 'en') select w, bool_and(c in (select c from known)) as convertible from (select w, unnest(string_split(w, '')) as c from words) group by w")
def c6(spark, sf):
    d = S.table(spark, sf, "documents")
    return C.convertible(words(spark, sf), "w", C.characters(d.filter("lang = 'en'"), "text"))


@query("c7_attribute_diff", RULES + ", a as (select side, locale, n from dg) select coalesce(o.locale, n.locale) as locale, case when o.locale is null then 'only new' when n.locale is null then 'only old' when o.n = n.n then 'same' else 'changed' end as status from (select * from a where side = 'old') o full join (select * from a where side = 'new') n on o.locale = n.locale")
def c7(spark, sf):
    return L.attribute_diff(L.rules_digest(rules(spark, sf)), "locale", "n")


VTESTS = cte(f"u as (select w as a, 'vind' as b, case when ko < {lit('vind', OLD)} then '<' when ko > {lit('vind', OLD)} then '>' else '=' end as o, case when kn < {lit('vind', NEW)} then '<' when kn > {lit('vind', NEW)} then '>' else '=' end as n from k)")


def tests(spark, sf):
    """Every word against one, with the signs of both sides."""
    d = words(spark, sf).select(F.col("w").alias("a"), F.lit("vind").alias("b"))
    return d.withColumn("o", keys.sign(F.col("a"), F.col("b"), OLD)).withColumn("n", keys.sign(F.col("a"), F.col("b"), NEW))


@query("v1_likeness", VTESTS + ", w as (select *, case length(a) % 5 when 0 then o when 1 then '?' else n end as answer from u) select a, case when answer = o and answer = n then 'both' when answer = o then 'old' when answer = n then 'new' else 'neither' end as \"like\" from w")
def v1(spark, sf):
    k, t = F.length("a") % 5, tests(spark, sf)
    return V.likeness(t.withColumn("answer", F.when(k == 0, F.col("o")).when(k == 1, "?").otherwise(F.col("n")))).select("a", "like")


@query("v2_completeness", VTESTS + " select a, 1::bigint as asked, case when length(a) % 5 = 0 then 0 else 2 end::bigint as given, case when length(a) % 5 = 0 then 'missing' else 'duplicate' end as problem from u where length(a) % 5 < 2 union all select a || '#', 0, 1, 'extra' from u where length(a) % 5 = 2")
def v2(spark, sf):
    t, k = tests(spark, sf), F.length("a") % 5
    given = V.answer_tests(t, NEW).select("a")
    twice = F.explode(F.when(k == 0, F.array()).when(k == 1, F.array("a", "a")).when(k == 2, F.array(F.col("a"), F.concat("a", F.lit("#")))).otherwise(F.array("a")))
    return V.completeness(t, given.select(twice.alias("a")), ["a"])


@query("v5_answer_tests", VTESTS + " select a, b, n as answer from u")
def v5(spark, sf):
    return V.answer_tests(tests(spark, sf), NEW).select("a", "b", "answer")


@query(
    "v3_verdict",
    VTESTS
    + ", d as (select count(*) as m, count(*) filter (o <> n) as t from u), s as (select unnest(['as they are', 'swapped', 'both old', 'both new', 'unknown', 'only old']) as case_) "
    + "select case_ as \"case\", case when case_ = 'only old' then m else 2 * m end as n, case when case_ = 'as they are' and t > 0 then 'confirmed' else 'refused' end as state, "
    + "case case_ when 'as they are' then '' when 'swapped' then 'the sides are swapped' when 'both old' then 'both sides answer like old' when 'both new' then 'both sides answer like new' when 'unknown' then 'the new side has answers like neither' else 'no answers of the new side' end as reasons from s, d",
)
def v3(spark, sf):
    t = settled(tests(spark, sf))
    out = None
    for case, old, new in (("as they are", "o", "n"), ("swapped", "n", "o"), ("both old", "o", "o"), ("both new", "n", "n"), ("unknown", "o", None), ("only old", "o", None)):
        sides = [("old", old)] + ([("new", new)] if case != "only old" else [])
        like = None
        for side, column in sides:
            one = V.likeness(t.withColumn("answer", F.col(column) if column else F.lit("?"))).select(F.lit(side).alias("side"), "like")
            like = one if like is None else like.unionByName(one)
        row = V.verdict(like).withColumn("case", F.lit(case))
        out = row if out is None else out.unionByName(row)
    return out


@query("p1_verdict_counts", RULES + ", " + STATE + " select d.state, count(st.state) as n from (select unnest(['same', 'differs', 'not compared', 'gone']) as state) d left join st on st.state = d.state group by d.state")
def p1(spark, sf):
    return V.verdict_counts(L.compare_rules(rules(spark, sf)), "state", ["same", "differs", "not compared", "gone"])


DBS = "with d as (select doc_id, case when doc_id % 5 = 0 then 'i' else 'c' end as provider, case when doc_id % 7 = 0 then 'C' when doc_id % 7 = 1 then 'C.UTF-8' else lang || '_' || upper(lang) end as datcollate, case when doc_id % 3 = 0 then null else '2.' || (28 + doc_id % 2) end as recorded_version, case when doc_id % 6 = 0 then null else '2.29' end as actual_version from documents) "


def databases(spark, sf):
    i = F.col("doc_id")
    return S.table(spark, sf, "documents").select(
        "doc_id", F.when(i % 5 == 0, "i").otherwise("c").alias("provider"), F.when(i % 7 == 0, "C").when(i % 7 == 1, "C.UTF-8").otherwise(F.concat("lang", F.lit("_"), F.upper("lang"))).alias("datcollate"),
        F.when(i % 3 != 0, F.concat(F.lit("2."), (28 + i % 2).cast("string"))).alias("recorded_version"), F.when(i % 6 != 0, "2.29").alias("actual_version"),
    )


@query("x8_database_exposure", DBS + "select doc_id, case when provider <> 'c' then 'not libc' when datcollate in ('C', 'POSIX') or regexp_matches(datcollate, '^[Cc][.]') then 'byte order' else 'exposed' end as verdict from d")
def x8(spark, sf):
    return V.database_exposure(databases(spark, sf)).select("doc_id", "verdict")


@query("x9_version_blind_spots", DBS + ", li as (select distinct lang || '_' || upper(lang) as name from documents union all select * from (values ('C.UTF-8'), ('xx_XX'))) select li.name, case when d.doc_id is null then 'not there' when recorded_version is null and actual_version is null then 'both unknown' when recorded_version is not distinct from actual_version then 'equal' else 'mismatch' end as status, count(*) as n from li left join d on d.datcollate = li.name group by 1, 2")
def x9(spark, sf):
    listed = S.table(spark, sf, "documents").select(F.concat("lang", F.lit("_"), F.upper("lang")).alias("name")).distinct().unionByName(spark.createDataFrame([("C.UTF-8",), ("xx_XX",)], "name string"))
    return V.version_blind_spots(databases(spark, sf).withColumnRenamed("datcollate", "name"), listed).groupBy("name", "status").agg(F.count("*").alias("n"))


NORMAL = "case when regexp_matches({x}, '^[^@.]*[.]') then regexp_extract({x}, '^[^@.]*') || '.' || case when regexp_matches({c}, '^[0-9]+$') then 'iso' || {c} else {c} end || regexp_extract({x}, '@.*$') else {x} end"


def _normal_sql(x: str) -> str:
    return NORMAL.format(x=x, c=f"lower(regexp_replace(regexp_extract({x}, '^[^@.]*[.]([^@]*)', 1), '[^A-Za-z0-9]', '', 'g'))")


@query("x10_gone_names", DBS + f", u as (select 'database' as kind, doc_id::varchar as obj, datcollate as value from d union select 'collation', source, lang || '_' || upper(lang) || '.8859-' || (doc_id % 3) || case when doc_id % 2 = 0 then '@euro' else '' end from documents union select 'setting', 'lc_time', lang || '_' || upper(lang) || '.UTF-8' from documents), g as (select * from (values ('fr_FR'), ('es_ES.iso8859_1@euro'), ('de_DE.utf8'), ('C.utf8'), ('nowhere')) t(name)) select distinct kind, obj, value from u where {_normal_sql('value')} in (select {_normal_sql('name')} from g)")
def x10(spark, sf):
    d, i = S.table(spark, sf, "documents"), F.col("doc_id")
    locale = F.concat("lang", F.lit("_"), F.upper("lang"))
    db = databases(spark, sf).select(F.lit("database").alias("kind"), i.cast("string").alias("obj"), F.col("datcollate").alias("value"))
    co = d.select(F.lit("collation").alias("kind"), F.col("source").alias("obj"), F.concat(locale, F.lit(".8859-"), (i % 3).cast("string"), F.when(i % 2 == 0, "@euro").otherwise("")).alias("value"))
    se = d.select(F.lit("setting").alias("kind"), F.lit("lc_time").alias("obj"), F.concat(locale, F.lit(".UTF-8")).alias("value"))
    gone = spark.createDataFrame([("fr_FR",), ("es_ES.iso8859_1@euro",), ("de_DE.utf8",), ("C.utf8",), ("nowhere",)], "name string")
    return V.gone_names_in_use([db, co, se], gone)


@query("x7_best_rank", DBS + ", h as (select datcollate as obj, doc_id % 3 as rank, provider as label from d), m as (select obj, min(rank) as rank from h group by obj) select h.obj, h.rank, string_agg(distinct label, ', ' order by label) as labels from h join m on m.obj = h.obj and m.rank = h.rank group by 1, 2")
def x7(spark, sf):
    return B.best_rank(databases(spark, sf).select(F.col("datcollate").alias("obj"), (F.col("doc_id") % 3).alias("rank"), F.col("provider").alias("label")))


@query("v7_dedup_warnings", "select text, min(doc_id) as pos from documents group by text")
def v7(spark, sf):
    return V.dedup_warnings(S.table(spark, sf, "documents").select("text", F.col("doc_id").alias("pos")))


def queries() -> dict:
    return {k: f for k, (f, _) in Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in Q.items() if s}
