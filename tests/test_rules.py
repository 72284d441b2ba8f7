"""Rule tables: ranges of character maps, elements of several characters, encodings, doubts, builds, names, graphs and includes."""

import random

import pytest
from pyspark.sql import functions as F

from lexishift.functions.keys import PROFILES as P
from lexishift.functions.keys import locale_source, sign
from lexishift.operators import charmaps as C
from lexishift.operators import confirm as V
from lexishift.operators import ctype as T
from lexishift.operators import elements as E
from lexishift.operators import graphs as G
from lexishift.operators import measured as M
from lexishift.operators import rules as L
from lexishift.sources.shared import settled

MAP = "side string, charmap string, lo int, hi int, bytes string"


def changes(spark, *rows):
    df = spark.createDataFrame([(s, "m", lo, hi, b) for s, lo, hi, b in rows], MAP)
    return {r.cp: r.change for r in C.charmap_delta(df).collect()}


def test_ranges_are_compared_by_their_members(spark):
    whole = ("old", 16, 19, "10")
    assert changes(spark, whole, ("new", 16, 17, "10"), ("new", 18, 19, "12")) == {}
    assert changes(spark, whole, ("new", 17, 19, "10")) == {16: "removed", **dict.fromkeys((17, 18, 19), "other bytes")}
    assert changes(spark, whole, ("new", 16, 19, "0010")) == dict.fromkeys(range(16, 20), "other bytes")
    assert changes(spark, whole, ("new", 16, 21, "10"), ("new", 18, 18, "99")) == {18: "other bytes", 20: "added", 21: "added"}
    assert changes(spark, ("old", 1, 3, "01")) == dict.fromkeys((1, 2, 3), "removed")
    # a later range hides the rest of an earlier one
    assert changes(spark, ("old", 10, 30, "10"), ("old", 15, 17, "80"), ("new", 10, 30, "10")) == {**dict.fromkeys((15, 16, 17), "other bytes"), **dict.fromkeys(range(18, 31), "added")}


def test_random_ranges_against_expansion(spark):
    rng, rows, want = random.Random(5), [], {}
    for m in range(12):
        sides = {}
        for side in ("old", "new"):
            table, at = {}, 0
            while at < 60:
                lo = at + rng.randrange(4)
                hi = lo + rng.randrange(1, 9)
                first, size = (lo + rng.choice((0, 0, 0, 7)), 2) if rng.random() < 0.9 else (lo, 1)
                rows.append((side, f"m{m}", lo, hi, f"{first:0{2 * size}X}"))
                table |= {cp: (first + cp - lo, size) for cp in range(lo, hi + 1)}
                at = hi + 1
            for cp in rng.sample(range(70), 6):
                rows.append((side, f"m{m}", cp, cp, f"{cp % 5:02X}"))
                table[cp] = (cp % 5, 1)
            sides[side] = table
        for cp in {*sides["old"], *sides["new"]}:
            a, b = sides["old"].get(cp), sides["new"].get(cp)
            if a != b:
                want[f"m{m}", cp] = "added" if a is None else "removed" if b is None else "other bytes"
    got = {(r.charmap, r.cp): r.change for r in C.charmap_delta(spark.createDataFrame(rows, MAP)).collect()}
    assert got == want and len(want) > 100


def plain_key(word, table):
    longest, at, levels = max(map(len, table)), 0, ["", "", ""]
    while at < len(word):
        for k in range(min(longest, len(word) - at), 0, -1):
            if word[at : at + k] in table:
                w = table[word[at : at + k]]
                break
        else:
            k, w = 1, (word[at],) * 3
        levels = [x + (y or "") for x, y in zip(levels, w, strict=True)]
        at += k
    return "\x01".join([*levels, word])


def test_a_profile_of_fifty_thousand_elements_with_contractions(spark):
    rng = random.Random(2)
    letters = "abcdefgh漢é😀"
    table = {"".join(rng.choice(letters) for _ in range(rng.choice((1, 2, 3, 5, 6, 7)))): (rng.choice(("x", "yz", None)), rng.choice("pq"), None if rng.random() < 0.2 else "r") for _ in range(60_000)}
    assert len(table) > 30_000
    table |= {f"e{i}": (str(i), "b", "c") for i in range(50_000 - len(table))}
    words = ["", *["".join(rng.choice(letters + "zZ") for _ in range(rng.randrange(30))) for _ in range(300)], "a" * 2000]
    weights = spark.createDataFrame([(e, *w) for e, w in table.items()], "element string, w1 string, w2 string, w3 string")
    got = E.k_join(spark.createDataFrame([(w,) for w in [*words, None]], "w string"), "w", weights).collect()
    assert len(got) == len(words) + 1 and all(r.key == (None if r.w is None else plain_key(r.w, table)) for r in got)


def test_elements_without_a_table(spark):
    none = spark.createDataFrame([], "element string, w1 string, w2 string, w3 string")
    assert E.k_join(spark.createDataFrame([("ab",)], "w string"), "w", none).first().key == "ab\x01ab\x01ab\x01ab"


@pytest.fixture(scope="module")
def encodings(spark):
    """An encoding of one, two and three bytes in a map of ranges, and one of single bytes."""
    rows = [("euc", 0, 127, "00"), ("euc", 0x3040, 0x309F, "A4A1"), ("euc", 0x4E00, 0x4E0F, "8FB0A1"), ("euc", 0xE9, 0xE9, "8FABB1"), ("one", 32, 126, "20"), ("one", 0x20AC, 0x20AC, "A4")]
    return spark.createDataFrame(rows, "charmap string, lo int, hi int, bytes string")


def test_bytes_in_any_encoding(spark, encodings):
    rows = [("41A4A18FB0A28fabb1", "euc"), ("41A4", "euc"), ("8FB0", "euc"), ("FF", "euc"), ("4", "euc"), ("", "euc"), (None, "euc"), ("41A4", "one"), ("41", "koi"), ("41", None)]
    got = {(r.h, r.e): (r.text, r.state) for r in C.decode_by_charmap(spark.createDataFrame(rows, "h string, e string"), "h", "e", encodings).collect()}
    cut = (None, "not convertible")
    assert got == {
        rows[0]: ("A぀丁é", "decoded"), rows[1]: cut, rows[2]: cut, rows[3]: cut, rows[4]: cut, rows[5]: ("", "decoded"), rows[6]: (None, None), rows[7]: ("A€", "decoded"), rows[8]: (None, "not known"), rows[9]: (None, "not known"),
    }


def test_binary_pairs_are_answered_in_their_encoding(spark, encodings):
    pairs = [("7761", "76", "one"), ("A4", "41", "one"), ("A4", "41", "euc"), ("41", "41", "none")]
    got = {(r.ah, r.encoding): (r.answer, r.state) for r in C.answer_binary_tests(spark.createDataFrame(pairs, "ah string, bh string, encoding string"), encodings, P["vw_old"]).collect()}
    first = spark.range(1).select(sign(F.lit("wa"), F.lit("v"), P["vw_old"]).alias("s"), sign(F.lit("€"), F.lit("A"), P["vw_old"]).alias("t")).first()
    assert got == {("7761", "one"): (first.s, "decoded"), ("A4", "one"): (first.t, "decoded"), ("A4", "euc"): (None, "not convertible"), ("41", "none"): (None, "not known")}


RULES = "side string, locale string, seq long, stmt string, chars array<int>, steers boolean"


def test_unknown_characters_are_not_no_characters(spark):
    rows = [("old", "none", 1, "x", [], False), ("new", "none", 1, "y", [], True), ("old", "unknown", 1, "x", None, False), ("new", "unknown", 1, "y", [5], False), ("old", "same", 1, "x", None, False), ("new", "same", 1, "x", None, False)]
    got = {r.locale: (r.chars, r.every_rule, r.why is None) for r in L.changed_chars(spark.createDataFrame(rows, RULES)).collect()}
    assert got == {"none": ([], True, True), "unknown": (None, False, False)}


def test_doubts_come_first(spark):
    held = [(s, n, 1, "x" if n != "moved" or s == "old" else "y", [1], False) for s in ("old", "new") for n in ("same", "moved", "doubted")] + [("new", "fresh", 1, "x", [1], False)]
    doubts = spark.createDataFrame([("new", "doubted", "cut short"), ("old", "doubted", "unsettled"), ("old", "fresh", "unread")], "side string, locale string, why string")
    aliases = [(s, a, t) for s in ("old", "new") for a, t in (("both", "same.UTF-8"), ("doubting", "doubted"), ("same", "moved"), ("lost", "nowhere"))] + [("old", "once", "same"), ("old", "turned", "same.KOI8"), ("new", "turned", "moved"), ("old", "later", "fresh"), ("new", "later", "fresh")]
    got = L.compare_rules(spark.createDataFrame(held, RULES), doubts, spark.createDataFrame(aliases, "side string, alias string, locale string"), lambda c: locale_source(F.col(c)))
    assert {r.locale: (r.state, r.why) for r in got.collect()} == {
        "same": ("same", None), "moved": ("differs", None), "doubted": ("not compared", "old side: unsettled"), "fresh": ("not compared", "only on the new side"), "both": ("same", None),
        "doubting": ("not compared", "old side: unsettled"), "once": ("not compared", "an alias on the old side only"), "turned": ("differs", None), "later": ("not compared", "built from fresh, which has no rules on the old side"),
    }


def test_builds_meet_by_any_entry(spark):
    rows = [("old", "e1", "s", "c1"), ("old", "e2", "s", "c1"), ("new", "e2", "s", "c2"), ("old", "f", "t", "c1"), ("new", "g", "t", "c1"), ("old", "h", "u", "c1"), ("new", "h", "v", "c2")]
    present = spark.createDataFrame([("old", "s"), ("new", "s"), ("old", "t")], "side string, source string")
    got = M.common_builds(spark.createDataFrame(rows, "side string, entry string, source string, charmap string"), present)
    assert {tuple(r) for r in got.collect()} == {("s", "e2", "e2", "c1", "c2", "compared"), ("t", "f", "g", "c1", "c1", "not compared")}


def test_a_name_takes_its_charmap_from_key_then_source(spark):
    one = lambda schema, *rows: spark.createDataFrame(list(rows), schema)
    names = one("name string", ("swedish",), ("sv_SE.UTF-8",), ("C",), ("own",), ("lost",))
    compared = one("locale string, state string, why string", ("swedish", "same", None), ("sv_SE", "differs", None))
    charmaps = one("file string, charmap string", ("sv_SE", "not compared"), ("sv_SE", "changed"), ("sv_SE", "transliteration"))
    got = M.rules_by_measured_name(names, one("alias string, locale string", ("swedish", "sv_SE.ISO-8859-1")), compared, charmaps, locale_source, one("key string, why string", ("own", "cut short")), one("name string", ("lost",)))
    assert {r.name: (r.key, r.state, r.why, r.charmap) for r in got.collect()} == {
        "swedish": ("swedish", "same", "", "changed"), "sv_SE.UTF-8": ("sv_SE", "differs", "", "changed"), "C": (None, "built in", "no locale file", "-"),
        "own": ("own", "not compared", "not read: cut short", "-"), "lost": ("lost", "not compared", "no locale file of that name", "not compared"),
    }


def test_aliases_of_one_side_are_not_compared(spark):
    aliases = [("old", "both", "a.X"), ("new", "both", "a.Y"), ("old", "gone", "a"), ("new", "fresh", "a"), ("old", "turned", "a"), ("new", "turned", "b"), ("old", "other", "b"), ("new", "other", "b"), ("old", "a", "a"), ("new", "a", "a")]
    got = L.alias_expand(spark.createDataFrame([("a",)], "name string"), spark.createDataFrame(aliases, "side string, alias string, locale string"), locale_source(F.col("locale")))
    assert {r.name: (r.listed, r.why) for r in got.collect()} == {
        "a": (True, None), "both": (False, None), "gone": (False, "not compared: an alias on the old side only"), "fresh": (False, "not compared: an alias on the new side only"), "turned": (False, "not compared: built from another file on each side"),
    }


def test_rules_of_another_measurement_are_refused(spark):
    one = lambda schema, *rows: spark.createDataFrame(list(rows), schema)
    verdicts, compared = one("locale string, verdict string", ("a", "same"), ("b", "same"), ("c", "same"), ("d", "same")), one("locale string, state string", ("a", "same"), ("b", "differs"), ("c", "same"))
    digests = one("locale string, measured string, compared string", ("a", "x", "x"), ("b", "x", "y"), ("d", "x", "x"))
    got = {r.locale: (r.state, r.beside) for r in L.rules_beside(verdicts, compared, digests).collect()}
    assert got == {"a": ("same", None), "b": ("refused", "the rules belong to another measurement"), "c": ("refused", "a digest is missing"), "d": ("no rules", None)}


def test_names_of_a_group_are_rows(spark):
    rows = spark.createDataFrame([("b", "s"), ("a", "s"), ("c", None), ("d", None), ("a", "s")], "name string, state string")
    assert {tuple(r) for r in L.group_alike(rows, ["state"], "name").collect()} == {("s", "a", "a", 2), ("s", "b", "a", 2), (None, "c", "c", 2), (None, "d", "c", 2)}


def walked(edges, stop=()):
    out = set()
    for a in {a for a, _ in edges}:
        seen, todo = set(), [a]
        while todo:
            n = todo.pop()
            if n == a and n in seen:
                continue
            for x, y in edges:
                if x == n and (n == a or n not in stop) and y not in seen:
                    seen.add(y), todo.append(y)
        out |= {(a, y) for y in seen}
    return out


@pytest.mark.parametrize("kind", ["chain", "cycle", "dense", "stops"])
def test_closure(spark, kind):
    rng = random.Random(3)
    edges = {"chain": [(i, i + 1) for i in range(1000)], "cycle": [(i, (i + 1) % 60) for i in range(60)] + [(3, 3), (70, 5)], "dense": [(rng.randrange(40), rng.randrange(40)) for _ in range(90)], "stops": [(rng.randrange(30), rng.randrange(30)) for _ in range(50)]}[kind]
    stop = [2, 5, 9] if kind == "stops" else []
    end = spark.createDataFrame([(x,) for x in stop], "dst int") if stop else None
    got = G.closure(spark.createDataFrame(edges, "src int, dst int"), stop=end)
    if kind == "chain":
        assert got.count() == 1000 * 1001 // 2 and got.distinct().count() == got.count()
    else:
        assert {tuple(r) for r in got.collect()} == walked(edges, stop)


def test_closure_makes_rows_in_proportion_to_its_answer(spark, monkeypatch):
    """Rows that the rounds write: the answer, once."""
    written = []
    monkeypatch.setattr(G, "settled", lambda df: written.append(settled(df)) or written[-1])
    n = G.closure(spark.createDataFrame([(i, i + 1) for i in range(200)], "src int, dst int")).count()
    assert sum(t.count() for t in written) == n and len(written) < 12


def test_includes_are_searched_depth_first(spark):
    roots = spark.createDataFrame([("s", "r"), ("t", "x")], "source string, tbl string")
    includes = spark.createDataFrame([("r", 1, "a"), ("r", 2, "b"), ("a", 1, "c"), ("b", 1, "c"), ("b", 2, "d"), ("c", 1, "b"), ("d", 5, "r"), ("x", 1, "x")], "tbl string, ord int, inc string")
    tables, loops = G.include_order(roots, includes)
    order = [r.tbl for r in tables.filter("source = 's'").orderBy("path").collect()]
    assert order == ["r", "a", "c", "b", "d"]
    assert {(r.source, tuple(r.path)) for r in loops.collect()} >= {("s", (0, 1, 1, 1, 1)), ("s", (0, 1, 1, 1, 2, 5)), ("t", (0, 1))}


def test_a_search_that_comes_back_is_unsettled(spark):
    one = lambda schema, *rows: spark.createDataFrame(list(rows), schema)
    elements = one("source string, cp int", ("s", 1), ("s", 2), ("s", 3), ("u", 9))
    roots = one("source string, tbl string", ("s", "r"), ("u", "v"))
    includes = one("tbl string, ord int, inc string", ("r", 1, "a"), ("a", 1, "r"), ("r", 2, "b"))
    entries = one("tbl string, ord int, cp int, alt int, answer array<int>", ("a", 1, 1, 0, [65]), ("b", 1, 2, 0, [66]), ("r", 1, 3, 0, [999]), ("r", 1, 3, 1, [67]), ("r", 0, 3, 0, [68]))
    got = M.translit_resolve(elements, roots, includes, entries, one("cp int", (65,), (66,), (67,), (68,)))
    old = {(r.source, r.cp): (r.state, r.answer) for r in got.collect()}
    assert old == {("s", 1): ("built", [65]), ("s", 2): ("unsettled", None), ("s", 3): ("built", [67])}
    new = M.translit_resolve(elements, roots, includes, entries, one("cp int", (65,), (66,), (68,)))
    assert {(r.cp, r.state, str(r.old), str(r.new)) for r in M.translit_diff(got, new).collect()} == {(2, "not compared", "None", "None"), (3, "not compared", "[67]", "None")}


def test_answers_of_case_and_class(spark):
    side = spark.createDataFrame([(65, "a", "A", "A", "alpha,upper"), (223, "ß", "ß", "Ss", "alpha,lower")], "cp int, lower string, upper string, title string, classes string")
    rows = [(65, "lower", "a", "A"), (65, "upper", "A", "A"), (223, "title", "ß", "Ss"), (223, "lower", "x", "y"), (65, "upper_", "t", "f"), (65, "alpha", "t", "f"), (66, "lower", "b", "B"), (66, "alpha", "t", "f")]
    got = {(r.cp, r.f): (r.answer, r.like) for r in M.answer_ctype(spark.createDataFrame(rows, "cp int, f string, o string, n string"), side).collect()}
    assert got == {
        (65, "lower"): ("a", "old"), (65, "upper"): ("A", "both"), (223, "title"): ("Ss", "new"), (223, "lower"): ("ß", "neither"), (65, "upper_"): ("f", "new"), (65, "alpha"): ("t", "old"), (66, "lower"): ("B", "new"), (66, "alpha"): ("f", "new"),
    }


def test_listed_names_and_uses_of_gone_names(spark):
    one = lambda schema, *rows: spark.createDataFrame(list(rows), schema)
    coll = one("name string, recorded_version string, actual_version string", ("a", "1", "2"), ("b", None, None), ("c", "1", "1"))
    assert {(r.name, r.status) for r in V.version_blind_spots(coll, one("name string", ("a",), ("b",), ("z",), ("z",))).collect()} == {("a", "mismatch"), ("b", "both unknown"), ("z", "not there")}
    use = "kind string, obj string, value string"
    uses = [one(use, ("database", "d", "sv_SE.UTF-8"), ("database", "d", "sv_SE.UTF-8"), ("database", "e", None)), one(use, ("collation", "c", "sv_SE.utf8@euro"), ("collation", "k", "sv_SE"), ("collation", "l", "sv_FI.8859-1"))]
    got = V.gone_names_in_use(uses, one("name string", ("sv_SE.utf8",), ("sv_FI.iso88591",)))
    assert {tuple(r) for r in got.collect()} == {("database", "d", "sv_SE.UTF-8"), ("collation", "l", "sv_FI.8859-1")}


def test_characters_that_differ_and_in_what(spark):
    rows = [("old", 1, "a", "A", "A", "x"), ("new", 1, "a", "B", "C", "y"), ("old", 2, None, "A", "A", "x"), ("new", 2, "", "A", "A", "x"), ("old", 3, "a", "A", "A", "x"), ("new", 3, "a", "A", "A", "x"), ("new", 4, "a", "A", "A", "x"), ("old", 5000, "a", "A", "A", "x")]
    df = spark.createDataFrame(rows, "side string, cp int, lower string, upper string, title string, classes string")
    blocks = T.changed_blocks(T.ctype_blocks(df))
    assert {r.block for r in blocks.collect()} == {0, 1}
    assert {tuple(r) for r in T.ctype_detail(df, blocks).collect()} == {(1, "other upper case; other title case; x -> y"), (2, "other lower case"), (4, "newly classified"), (5000, "gone")}
