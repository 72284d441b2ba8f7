"""Golden orders and counts, three-valued answers, and registered queries against DuckDB."""

from hashlib import md5

import duckdb
import pytest
from pyspark.sql import functions as F

from lexishift.functions.keys import PROFILES as P
from lexishift.functions.keys import bucket_expr, key, locale_source, normalize_codeset, parse_string_name, sign, string_name
from lexishift.operators import breakage as B
from lexishift.operators import confirm as V
from lexishift.operators import order as O
from lexishift.operators import rules as L
from lexishift.operators import exposure as E
from lexishift.operators import elements
from lexishift.operators import measured as M
from lexishift.plans import audit, catalog, exposure, measured
from lexishift.sources import corpus as S

SF = "/root/testdata/sf0.001"
OLD, NEW = P["vw_old"], P["vw_new"]
SEVEN = ["va", "Vasa", "vind", "vz", "wa", "Wasa", "wind"]


@pytest.fixture(scope="module")
def seven(spark):
    return spark.createDataFrame([(w,) for w in SEVEN], "w string")


@pytest.mark.parametrize(("profile", "order"), [("vw_old", "va wa Vasa Wasa vind wind vz"), ("vw_new", "va Vasa vind vz wa Wasa wind"), ("bytes", "Vasa Wasa va vind vz wa wind")])
def test_published_orders(seven, profile, order):
    assert [r.w for r in seven.orderBy(key(F.col("w"), P[profile])).collect()] == order.split()


def test_ranks_violations_and_inversions(seven):
    found = {r.w: (r.old_rank, r.new_rank) for r in O.ranks(seven, OLD, NEW).collect()}
    assert found["wa"] == (2, 5) and found["va"] == (1, 1)
    assert {(r.prev, r.w) for r in O.order_violations(seven, OLD, NEW).collect()} == {("wa", "Vasa"), ("Wasa", "vind"), ("wind", "vz")}
    moved = O.inversion_participants(seven, OLD, NEW)
    assert {r.w for r in moved.collect()} == set(SEVEN) - {"va"}
    pairs = moved.select(sign(F.col("w"), F.col("witness"), OLD).alias("o"), sign(F.col("w"), F.col("witness"), NEW).alias("n")).collect()
    assert all({r.o, r.n} == {"<", ">"} for r in pairs)
    assert O.rank_diff(seven, NEW, P["same"]).first().same


def test_bucketed_ranks_equal_a_plain_sort(spark):
    df = S.corpus(spark.range(9000))
    assert O.bucketed(df, "w").select("_bucket").distinct().count() == 4
    got = [r.w for r in O.rank(df, key(F.col("w"), OLD)).orderBy("rank").collect()]
    assert got == [r.w for r in df.orderBy(key(F.col("w"), OLD)).collect()] and len(set(got)) == 9000


@pytest.fixture(scope="module")
def published(spark):
    """The corpus of 20,000 words, and the seven readable ones."""
    words = S.corpus(spark.range(20000)).select("w")
    return words, words.unionByName(spark.createDataFrame([(w,) for w in S.READABLE], "w string"))


def test_published_numbers(published):
    words, every = published
    below = lambda df, p: df.filter(key(F.col("w"), p) < key(F.lit("vz"), p)).count()
    assert words.distinct().count() == 20000 and (below(words, OLD), below(words, NEW)) == (19232, 9616) and below(every, OLD) == 19238
    stored = every.withColumn("part", B.route(F.col("w"), audit.BOUNDS, OLD))
    assert B.misplaced(stored, audit.BOUNDS, NEW).count() == 9619
    fixed = B.repartition_fix(stored, audit.BOUNDS, NEW)
    assert B.misplaced(fixed, audit.BOUNDS, NEW).count() == 0 and {r.part: r["count"] for r in stored.groupBy("part").count().collect()} == {"lo": 19238, "hi": 769}
    checked = words.filter(key(F.col("w"), OLD) < key(F.lit("vz"), OLD))
    assert B.check_violations(checked, key(F.col("w"), NEW) < key(F.lit("vz"), NEW)).count() == 9616
    generated = words.withColumn("bucket", bucket_expr(F.col("w"), "vz", OLD))
    assert B.stale(generated, "bucket", bucket_expr(F.col("w"), "vz", NEW)).count() == 9616
    drift = {r.status: r.n for r in B.range_drift(every, "wa", "wb", OLD, NEW).collect()}
    assert (drift["stay"], drift["stay"] + drift["leave"]) == (388, 775) and "enter" not in drift
    inside = lambda p, lo, hi: words.filter((key(F.col("w"), p) >= key(F.lit(lo), p)) & (key(F.col("w"), p) < key(F.lit(hi), p))).count()
    assert [inside(p, "wa", "wb") for p in (OLD, NEW)] == [772, 386] and [inside(p, "vfx", "vfxzzz") for p in (OLD, NEW)] == [28, 14]
    # the control: a profile against itself moves nothing
    assert O.rank_diff(words, NEW, P["same"]).first().same and B.misplaced(words.withColumn("part", B.route(F.col("w"), audit.BOUNDS, NEW)), audit.BOUNDS, P["same"]).count() == 0


def test_digest_has_as_many_levels_as_it_needs(spark):
    df, other = S.corpus(spark.range(300)), S.corpus(spark.range(1, 301))
    one = lambda d: O.order_digest(d, OLD, 5).first().digest
    assert one(df) == one(df.repartition(7)) != one(other)


@pytest.mark.parametrize(("n", "block"), [(0, 5), (4, 5), (23, 5), (25, 5), (26, 5), (300, 5)])
def test_digest_is_of_the_hashes_of_all_blocks(spark, n, block):
    """As in the query's SQL, however many blocks there are: null for no strings, and no further levels beyond ``block`` blocks."""
    df = S.corpus(spark.range(n))
    held = [r.w for r in df.orderBy(key(F.col("w"), OLD)).collect()]
    blocks = [md5(",".join(held[i : i + block]).encode()).hexdigest() for i in range(0, n, block)]
    assert O.order_digest(df.repartition(3), OLD, block).first().digest == (md5(",".join(blocks).encode()).hexdigest() if n else None)


def test_controls_of_an_empty_table_are_those_of_its_sql(spark, duck):
    told = O.controls(spark.createDataFrame([], "w string"), OLD, NEW, (P["ch_old"], P["same"]), P["bytes"]).collect()
    sql = audit.Q["o12_controls"][1].replace("from documents", "from documents where false")
    assert [tuple(r) for r in told] == duck.execute(sql).fetchall()


def test_nulls_are_neither_misplaced_nor_violations(spark):
    df = spark.createDataFrame([("wa", "lo"), (None, None), ("va", "lo")], "w string, part string")
    assert [r.w for r in B.misplaced(df, audit.BOUNDS, NEW).collect()] == ["wa"]
    assert B.check_violations(df, F.col("w") < "vz").count() == 1
    assert {(r.w, r.answer, r.why) for r in B.admit(df.select("w"), df.filter("w = 'va'").select("w"), df.select("w"), F.lit(True)).collect()} == {("wa", "ACCEPTED", None), ("va", "REJECTED", "unique"), (None, "NOT ASKED", "missing input")}


def test_names(spark):
    df = spark.createDataFrame([("sv_SE.UTF-8@euro", "U+0057"), ("de_DE", "U+1F600")], "n string, u string")
    rows = df.select(locale_source(F.col("n")).alias("s"), normalize_codeset(F.col("n")).alias("c"), parse_string_name(F.col("u")).alias("p"), string_name(parse_string_name(F.col("u"))).alias("u2"), "u").collect()
    assert [r.s for r in rows] == ["sv_SE@euro", "de_DE"] and rows[0].c == "utf8" and [r.p for r in rows] == ["W", "😀"] and all(r.u == r.u2 for r in rows)


def test_missing_sides_are_not_compared(spark):
    rules = spark.createDataFrame([("old", "a", 1, "x", [1], False), ("new", "a", 1, "x", [1], False), ("old", "b", 1, "x", [2], True), ("new", "b", 1, "y", [3], False), ("old", "c", 1, "x", [1], False)], "side string, locale string, seq long, stmt string, chars array<int>, steers boolean")
    assert {(r.locale, r.state) for r in L.compare_rules(rules).collect()} == {("a", "same"), ("b", "differs"), ("c", "not compared")}
    assert {(r.locale, tuple(r.chars), r.every_rule) for r in L.changed_chars(rules).collect()} == {("b", (2, 3), True), ("c", (1,), False)}


def test_verdicts(spark, seven):
    tests = seven.select(F.col("w").alias("a"), F.lit("vind").alias("b")).withColumn("o", sign(F.col("a"), F.col("b"), OLD)).withColumn("n", sign(F.col("a"), F.col("b"), NEW))
    like = lambda side, t, p: V.likeness(V.answer_tests(t, p)).select(F.lit(side).alias("side"), "like")
    judged = lambda old, new: tuple(V.verdict(old.unionByName(new)).select("state", "reasons").first())
    assert judged(like("old", tests, OLD), like("new", tests, NEW)) == ("confirmed", "")
    assert judged(like("old", tests, NEW), like("new", tests, OLD)) == ("refused", "the sides are swapped")
    assert judged(like("old", tests, OLD), like("new", tests, OLD)) == ("refused", "both sides answer like old")
    assert judged(like("old", tests, OLD), like("new", tests.limit(0), NEW)) == ("refused", "no answers of the new side")
    alike = tests.filter("o = n")
    assert judged(like("old", alike, OLD), like("new", alike, NEW)) == ("refused", "no answer of the old side tells the sides apart; no answer of the new side tells the sides apart")
    mixed = like("new", tests.filter("o <> n"), OLD).unionByName(like("new", tests, NEW))
    assert judged(like("old", tests, OLD), mixed) == ("refused", "the new side is mixed")


def test_closure_with_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "src string, dst string")
    assert L.closure(edges).count() == 12


def test_strict_reader_refuses_a_short_file(spark, tmp_path):
    f = tmp_path / "rows.tsv"
    f.write_text("# comment\na\tb\nc\td\n# rows 2\n")
    assert S.read_rows_tsv(spark, str(f), ["x", "y"]).count() == 2
    f.write_text("# comment\na\tb\nc\td\n# rows 2 groups 2\n")
    assert S.read_rows_tsv(spark, str(f), ["x", "y"]).count() == 2
    for bad in ("# comment\na\tb\n# rows 2\n", "a\tb\na\td\n# rows 2 groups 2\n", "a\tb\tc\n# rows 1\n", "a\tb\n"):
        f.write_text(bad)
        with pytest.raises(ValueError):
            S.read_rows_tsv(spark, str(f), ["x", "y"])


def test_sources_split_and_names_of_several_characters(spark):
    df = spark.createDataFrame([("W",), ("é漢",)], "s string")
    assert [r.n for r in df.select(string_name(F.col("s")).alias("n")).collect()] == ["U+0057", "bytes C3 A9 E6 BC A2"]
    assert [r.b for r in df.select(parse_string_name(string_name(F.col("s"))).alias("b")).collect()] == ["W", "é漢"]


def test_a_void_control_is_no_answer(seven):
    same, moved = (P["same"], P["same"]), (P["vw_old"], P["vw_new"])
    answer = lambda old, new, control: O.controls(seven, old, new, control, P["bytes"]).first().verdict
    assert [answer(OLD, NEW, same), answer(NEW, P["same"], same), answer(OLD, NEW, moved), answer(P["bytes"], NEW, same)] == ["differs", "same", "void", "void"]


def test_chain_and_roots(spark):
    one = lambda *w: spark.createDataFrame([(x,) for x in w], "w string")
    assert {tuple(r) for r in O.chain_union(one("a", "b"), one("b", "c"), one("a", "d")).collect()} == {("a", "both"), ("b", "only steps"), ("c", "only steps"), ("d", "only whole")}
    edges = spark.createDataFrame([("a", "b"), ("b", "r"), ("r", "s"), ("s", "a")], "src string, dst string")
    roots = spark.createDataFrame([("r",), ("s",)], "root string")
    assert {tuple(x) for x in L.nearest_roots(edges, roots).collect()} == {("a", "r"), ("b", "r"), ("r", "s"), ("s", "r")}
    assert catalog.l5 is audit.Q["l5_roots"][0]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "w string")
    assert O.rank(empty, key(F.col("w"), OLD)).count() == 0 and B.histogram(empty, OLD, 4).count() == 0 and O.ties(empty, OLD).first().n_tied == 0
    assert empty.withColumn("b", bucket_expr(F.col("w"), "vz", OLD)).count() == 0


@pytest.fixture(scope="module")
def catalogs(spark):
    databases = spark.createDataFrame([(1, "c", "sv_SE", "sv_SE"), (2, "i", "C", "C"), (3, "c", "C", "C")], "db int, provider string, datcollate string, datctype string")
    rows = [(db, *c) for db in (1, 2, 3) for c in ((100, "default", "d", None, None), (1, "sv_SE", "c", "sv_SE", "sv_SE"), (2, "C", "c", "C", "C"), (3, "half", "c", "C", "sv_SE"), (4, "icu", "i", None, None))]
    return databases, E.library_collations(spark.createDataFrame(rows, "db int, oid int, label string, provider string, collcollate string, collctype string"), databases)


def test_exposed_indexes_as_expected_in_both_directions(spark, catalogs):
    databases, library = catalogs
    # (db, index, method, computes, collation of its key, extension, json, tsvector, collations it reads) -> labels, None where it is not exposed
    want = {
        (1, "plain", "btree", False, 1, False, False, False, ()): "sv_SE", (1, "bytes", "btree", False, 2, False, False, False, ()): None, (1, "hashed", "hash", False, 1, False, False, False, ()): None,
        (1, "hashed expression", "hash", True, 1, False, False, False, ()): "sv_SE", (1, "by default", "btree", False, 100, False, False, False, ()): "default", (2, "by default", "btree", False, 100, False, False, False, ()): None,
        (1, "characters", "btree", False, 3, False, False, False, ()): None, (1, "characters computed", "btree", True, 3, False, False, False, ()): "half", (1, "trigram", "gin", False, 2, True, False, False, ()): "database LC_CTYPE sv_SE",
        (3, "trigram", "gin", False, 2, True, False, False, ()): None, (1, "search", "gin", True, 0, False, False, True, ()): "database LC_CTYPE sv_SE", (1, "json", "btree", False, 0, False, True, False, ()): "default",
        (1, "json gin", "gin", False, 0, False, True, False, ()): None, (1, "partial", "btree", True, 0, False, False, False, (1,)): "sv_SE", (1, "include", "btree", False, 2, False, False, False, (1,)): None, (1, "icu", "btree", False, 4, False, False, False, ()): None,
    }
    indexes = spark.createDataFrame([k[:4] for k in want], "db int, obj string, method string, computes boolean")
    keys = spark.createDataFrame([(k[0], k[1], *k[4:8]) for k in want], "db int, obj string, colloid int, extension boolean, json boolean, tsvector boolean")
    reads = spark.createDataFrame([(k[0], k[1], c) for k in want for c in k[8]], "db int, obj string, colloid int")
    got = {(r.db, r.obj): r.labels for r in E.exposed_indexes(indexes, keys, reads, library, databases).collect()}
    assert got == {k[:2]: v for k, v in want.items() if v}


def test_exposed_checks_generated_and_views(spark, catalogs):
    databases, library = catalogs
    reads = spark.createDataFrame([(1, "a", 1, "t"), (1, "b", 2, "t"), (1, "c", 0, "u"), (3, "d", 2, "t"), (1, "e", 3, "v"), (1, "e", 2, "w")], "db int, obj string, colloid int, source string")
    rows = lambda df: {(r.db, r.obj, r["rank"], r.labels) for r in df.collect()}
    want = {(1, "a", 1, "sv_SE"), (1, "b", 2, "database LC_CTYPE sv_SE"), (1, "e", 1, "half")}
    assert rows(E.exposed_checks(reads, library, databases)) == want
    search = spark.createDataFrame([(1, "c", "u"), (3, "d", None)], "db int, obj string, source string")
    assert rows(E.exposed_generated(reads, search.drop("source"), library, databases)) == want | {(1, "c", 2, "database LC_CTYPE sv_SE")}
    assert {(r.obj, r.reads_from) for r in E.exposed_matviews(reads, search, library, databases).collect()} == {("a", "t"), ("b", "t"), ("c", "u"), ("e", "v")}


def test_exposed_partitions(spark, catalogs):
    databases, library = catalogs
    keys = spark.createDataFrame([(1, "range", "r", False, 1, False, False), (1, "list", "l", False, 1, False, False), (1, "list of lower", "l", True, 1, False, False), (1, "citext", "h", False, 2, True, False), (1, "json", "r", False, 0, False, True)], "db int, obj string, strategy string, expression boolean, colloid int, extension boolean, json boolean")
    children = spark.createDataFrame([(1, "range"), (1, "range")], "db int, obj string")
    none = spark.createDataFrame([], "db int, obj string, colloid int")
    got = {r.obj: (r.labels, r.partitions) for r in E.exposed_partitions(keys, none, children, library, databases).collect()}
    assert got == {"range": ("sv_SE", 2), "list of lower": ("sv_SE", 0), "citext": ("database LC_CTYPE sv_SE", 0), "json": ("default", 0)}


def test_byte_order_through_single_copies(spark):
    one = lambda *w: spark.createDataFrame([(x,) for x in w], "locale string")
    copies = spark.createDataFrame([("a", "C"), ("b", "a"), ("two", "C"), ("two", "a"), ("own", "C"), ("x", "y"), ("y", "x")], "src string, dst string")
    assert {(r.locale, r.how, r.of) for r in M.byte_order(one("C"), copies, one("own")).collect()} == {("C", "declared", None), ("a", "by copy", "C"), ("b", "by copy", "a")}


def test_common_builds_pair_renamed_entries_and_changed_charmaps(spark):
    rows = [("old", "az.UTF-8", "az", "UTF-8"), ("new", "az", "az", "UTF-8"), ("old", "tt", "tt", "KOI8-T"), ("new", "tt", "tt", "UTF-8"), ("old", "gone", "gone", "UTF-8"), ("new", "fresh", "fresh", "UTF-8")]
    got = M.common_builds(spark.createDataFrame(rows, "side string, entry string, source string, charmap string")).collect()
    assert {tuple(r) for r in got} == {("az", "az.UTF-8", "az", "UTF-8", "UTF-8", "compared"), ("tt", "tt", "tt", "KOI8-T", "UTF-8", "compared")}


def test_a_valid_report_has_no_violations(spark):
    runs = spark.createDataFrame([("a", 0, 1, 3), ("a", 1, 5, 5), ("b", 0, 4, 2), ("c", 0, 1, 5), ("c", 1, 5, 6)], "locale string, seq int, first int, last int")
    runs = runs.select("locale", "seq", *[F.struct(F.lit(0).cast("tinyint").alias("kind"), F.lit(1).alias("len"), F.col(c).cast("decimal(38,0)").alias("value")).alias(c) for c in ("first", "last")])
    told = spark.createDataFrame([("a", 4), ("b", -1), ("c", 9)], "locale string, n int")
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "locale string")
    verdicts = spark.createDataFrame([("a", "changed"), ("b", "same"), ("c", "changed")], "locale string, verdict string")
    good = lambda df: df.filter("locale = 'a'")
    assert M.validate(good(runs), good(told), names("a"), good(verdicts)).count() == 0
    got = {tuple(r) for r in M.validate(runs, told, names("a", "a", "b"), verdicts).collect()}
    assert got == {("b", "empty run"), ("c", "run not after the one before"), ("c", "count differs"), ("c", "changed and in no group"), ("b", "in a group and not changed"), ("a", "in two groups")}


def test_page_drift_counts_what_a_client_skips_and_repeats(spark):
    df = S.corpus(spark.range(0, 20000, 37)).select("w")
    for size in (1, 7, 50):
        placed = sorted((r.old_rank, r.new_rank) for r in O.ranks(df, OLD, NEW).collect())
        want = {}
        for o, n in placed:
            if o % size == 0:
                want[o // size] = (sum(a > o and b < n for a, b in placed), sum(a <= o and b > n for a, b in placed))
        got = {r.page: (r.n_skipped, r.n_twice) for r in O.page_drift(df, size, OLD, NEW).collect()}
        assert got == want and any(a for a, _ in want.values()) and any(b for _, b in want.values())


def test_keys_from_a_table_equal_keys_from_literals(spark):
    df = spark.createDataFrame([("Vasa",), ("",), (None,), ("wä漢",)], "w string")
    chars = [(c,) for c in "Vaswä"]
    from lexishift.functions.keys import levels

    weights = spark.createDataFrame(chars, "element string").select("element", *[x.alias(n) for n, x in zip(("w1", "w2", "w3"), levels(F.col("element"), NEW), strict=True)])
    rows = elements.k_join(df, "w", weights).select("w", "key", key(F.col("w"), NEW).alias("k")).collect()
    assert len(rows) == 4 and all(r.key == r.k for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", ["b2_misplaced", "o2_rank_diff", "o5_inversions", "b21_prefix_sweep", "l2_compare_rules", "l9_charmap_delta", "c3_ctype_detail", "b16_admit", "o3_named_pairs", "b23_histogram_check", "b24_three_state", "l5_roots", "l11_affected_builds", "x1_collation_halves", "x2_exposed_indexes", "x4_exposed_partitions", "x6_exposed_matviews", "l14_translit_resolve", "p4_validate", "f2_k_join"])
def test_query_against_duckdb(spark, duck, name):
    f, sql = audit.Q[name]
    got, want = f(spark, SF).toPandas(), duck.execute(sql).df()
    columns = sorted(got.columns)
    rows = lambda d: sorted(map(str, d[columns].astype(object).where(d[columns].notna(), None).itertuples(index=False, name=None)))
    assert columns == sorted(want.columns) and rows(got) == rows(want)
