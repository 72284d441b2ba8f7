"""Measured names, builds, transliterations, findings and their report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexishift.operators.graphs import closure, include_order
from lexishift.operators.rules import both_sides, strongest_state, sum_hash
from lexishift.operators.strings import run_problems


def ctype_changes(ctype: DataFrame) -> DataFrame:
    """C4: (cp, joins, leaves, state) for code points whose classes differ: the classes that each joins and leaves; ``newly classified``
    and ``gone`` where a side lacks it."""
    split = lambda c: F.filter(F.split(F.coalesce(F.col(c), F.lit("")), ","), lambda x: x != "")
    d = both_sides(ctype.select("side", "cp", "classes"), ["cp"]).filter(~F.col("old_classes").eqNullSafe(F.col("new_classes")))
    joined = lambda a, b: F.array_join(F.array_sort(F.array_except(split(a), split(b))), ",")
    state = F.when(F.col("in_old").isNull(), "newly classified").when(F.col("in_new").isNull(), "gone").otherwise("changed")
    return d.select("cp", joined("new_classes", "old_classes").alias("joins"), joined("old_classes", "new_classes").alias("leaves"), state.alias("state"))


def byte_order(declared: DataFrame, copies: DataFrame, ruled: DataFrame) -> DataFrame:
    """(locale, how, of): locales whose one statement declares byte order, and those without rules of their own (not in ``ruled``)
    that copy a single locale which is in byte order itself. ``copies``: (src, dst)."""
    own = declared.select(F.col("locale").alias("dst")).distinct()
    single = copies.distinct().groupBy("src").agg(F.min("dst").alias("dst"), F.count("*").alias("n")).filter("n = 1").drop("n").join(ruled.select(F.col("locale").alias("src")), "src", "left_anti")
    reached = closure(single, stop=own).join(own, "dst", "left_semi").select("src").distinct()
    by_copy = single.join(reached, "src").select(F.col("src").alias("locale"), F.lit("by copy").alias("how"), F.col("dst").alias("of"))
    return declared.select("locale").distinct().select("locale", F.lit("declared").alias("how"), F.lit(None).cast("string").alias("of")).unionByName(by_copy)


def common_builds(builds: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """(source, old_entry, new_entry, old_charmap, new_charmap, state) of builds (side, entry, source, charmap) that are compared: the same
    source in the same charmap, whatever the entry is called, else the same entry and source whose charmap alone changed.

    Any entry of a source and charmap that the other side does not build may meet its namesake; of several that do, the least is told. ``present`` (side, source) names
    the sources that each side has: a pair whose source a side lacks is ``not compared``."""
    one = builds.groupBy("side", "source", "charmap").agg(F.min("entry").alias("entry"))
    d = both_sides(one, ["source", "charmap"])
    same = d.filter("in_old and in_new").select("source", "old_entry", "new_entry", F.col("charmap").alias("old_charmap"), F.col("charmap").alias("new_charmap"))
    other = lambda side: builds.filter(F.col("side") != side).select("source", "charmap").distinct()
    left = lambda side: builds.filter(F.col("side") == side).join(other(side), ["source", "charmap"], "left_anti").select("source", "entry", F.col("charmap").alias(f"{side}_charmap")).distinct()
    moved = left("old").join(left("new"), ["source", "entry"]).groupBy("source", "old_charmap", "new_charmap").agg(F.min("entry").alias("old_entry"))
    pairs = same.unionByName(moved.withColumn("new_entry", F.col("old_entry")))
    if present is None:
        return pairs.withColumn("state", F.lit("compared"))
    has = present.groupBy("source").agg(F.count_if(F.col("side") == "old").alias("_o"), F.count_if(F.col("side") == "new").alias("_n"))
    return pairs.join(has, "source", "left").withColumn("state", F.when((F.col("_o") > 0) & (F.col("_n") > 0), "compared").otherwise("not compared")).drop("_o", "_n")


def unbuilt_affected(edges: DataFrame, hits: DataFrame, built: DataFrame, sources: DataFrame, client_only: DataFrame) -> DataFrame:
    """(source, charmap, n_chars) for sources whose files, own or copied, name a changed character of a charmap in which they are not
    built; charmaps that only clients use are left out. It starts from the hits, so sources and charmaps are not crossed."""
    reach = closure(edges).unionByName(sources.select(F.col("source").alias("src"), F.col("source").alias("dst"))).distinct()
    open_ = hits.join(client_only.select("charmap").distinct(), "charmap", "left_anti").distinct()
    found = reach.join(open_, F.col("dst") == F.col("file")).select(F.col("src").alias("source"), "charmap", "cp").distinct()
    return found.join(sources.select("source").distinct(), "source", "left_semi").join(built.select("source", "charmap").distinct(), ["source", "charmap"], "left_anti").groupBy("source", "charmap").agg(F.count("*").alias("n_chars"))


def translit_resolve(elements: DataFrame, roots: DataFrame, includes: DataFrame, entries: DataFrame, charmap: DataFrame) -> DataFrame:
    """(source, cp, state, answer): what each element (source, cp) is built out of; no row where nothing answers.

    A source's search begins in its own table (``roots``: source, tbl) and goes on, depth first, through what each table includes (``includes``: tbl, ord, inc). In a table the
    newest of the ``entries`` (tbl, ord, cp, alt, answer) for a character counts, and of its alternatives the first whose characters all are in the ``charmap``
    (cp); where it has none, nothing comes from this table, and its includes are searched. A search that comes back to a table it is still in before anything has answered
    is ``unsettled``.
    """
    newest = entries.groupBy("tbl", "cp").agg(F.max("ord").alias("ord"))
    live = entries.join(newest, ["tbl", "cp", "ord"])
    need = live.select("tbl", "cp", "alt", F.explode(F.array_distinct("answer")).alias("_c"))
    lacking = need.join(charmap.select(F.col("cp").alias("_c")).distinct(), "_c", "left_anti").select("tbl", "cp", "alt").distinct()
    usable = live.join(lacking, ["tbl", "cp", "alt"], "left_anti")
    tables, loops = include_order(roots, includes)
    asked = elements.select("source", "cp").distinct()
    found = asked.join(tables, "source").join(usable, ["tbl", "cp"]).groupBy("source", "cp").agg(F.min(F.struct("path", "alt", "answer")).alias("_b"))
    stuck = loops.groupBy("source").agg(F.min("path").alias("_stuck"))
    d = asked.join(found, ["source", "cp"], "left").join(stuck, "source", "left")
    state = F.when(F.col("_b").isNotNull() & (F.col("_stuck").isNull() | (F.col("_b.path") < F.col("_stuck"))), "built").when(F.col("_stuck").isNotNull(), "unsettled")
    return d.withColumn("state", state).filter("state is not null").select("source", "cp", "state", F.when(F.col("state") == "built", F.col("_b.answer")).alias("answer"))


def translit_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(source, cp, state, old, new) for elements that are built otherwise, null where one side has no answer; ``not compared`` where a side is unsettled."""
    both = old.withColumn("side", F.lit("old")).unionByName(new.withColumn("side", F.lit("new")))
    d = both_sides(both, ["source", "cp"])
    doubt = (F.coalesce("old_state", F.lit("")) == "unsettled") | (F.coalesce("new_state", F.lit("")) == "unsettled")
    moved = d.filter(doubt | ~F.col("old_answer").eqNullSafe(F.col("new_answer")))
    return moved.select("source", "cp", F.when(doubt, "not compared").otherwise("differs").alias("state"), F.col("old_answer").alias("old"), F.col("new_answer").alias("new"))


def rules_by_measured_name(names: DataFrame, aliases: DataFrame, compared: DataFrame, charmaps: DataFrame, source, unread: DataFrame | None = None, untraced: DataFrame | None = None) -> DataFrame:
    """(name, key, state, why, charmap) for every measured name: the rules of the name itself, else of the file it is built from
    (``source`` over the alias's target or the name); C and POSIX are built in and have no file.

    A key that stands in ``unread`` (key, why) is not compared, whatever the comparison says. ``charmap`` is the strongest of the ``charmaps`` (file, charmap) states of the key, else of the source file,
    else ``not compared`` for an ``untraced`` (name), else '-'.
    """
    target = aliases.groupBy("alias").agg(F.min("locale").alias("_to"))
    d = names.select("name").distinct().join(target, F.col("name") == F.col("alias"), "left").select("name", source(F.coalesce("_to", "name")).alias("_src"))
    have = compared.select(F.col("locale").alias("_l"), F.col("state").alias("_st"), F.coalesce("why", F.lit("")).alias("_why"))
    d = d.join(have.select(F.col("_l").alias("_own")), F.col("name") == F.col("_own"), "left").withColumn("key", F.coalesce("_own", "_src"))
    d = d.join(have, F.col("key") == F.col("_l"), "left")
    if unread is None:
        d = d.withColumn("_ur", F.lit(None).cast("string"))
    else:
        d = d.join(unread.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("why")), "; ").alias("_ur")), "key", "left")  # a key's few reasons
    strongest = strongest_state(charmaps, "file", "charmap")
    at = lambda c, n: strongest.select(F.col("file").alias(f"_{n}f"), F.col("charmap").alias(n))
    d = d.join(at("key", "_cm1"), F.col("key") == F.col("__cm1f"), "left").join(at("_src", "_cm2"), F.col("_src") == F.col("__cm2f"), "left")
    if untraced is None:
        d = d.withColumn("_lost", F.lit(None).cast("string"))
    else:
        d = d.join(untraced.select("name", F.lit("not compared").alias("_lost")).distinct(), "name", "left")
    built_in = F.col("name").isin("C", "POSIX")
    return d.select(
        "name", F.when(~built_in, F.col("key")).alias("key"), F.when(built_in, "built in").when(F.col("_ur").isNotNull(), "not compared").otherwise(F.coalesce("_st", F.lit("not compared"))).alias("state"),
        F.when(built_in, "no locale file").when(F.col("_ur").isNotNull(), F.concat(F.lit("not read: "), "_ur")).otherwise(F.coalesce("_why", F.lit("no locale file of that name"))).alias("why"),
        F.when(built_in, "-").otherwise(F.coalesce("_cm1", "_cm2", "_lost", F.lit("-"))).alias("charmap"),
    )


CASES = ("lower", "upper", "title")


def answer_ctype(rows: DataFrame, side: DataFrame) -> DataFrame:
    """V6: (cp, f, answer, like) of class and case tests (cp, f, o, n) under a side's character rules (cp, lower, upper, title, classes): the three cases
    ask for a string, every other ``f`` for membership in that class. A character that the side lacks is its own case and in no class."""
    held = [c for c in CASES if c in side.columns]
    met = rows.join(side.select("cp", *held, "classes"), "cp", "left")
    member = F.when(F.array_contains(F.split(F.coalesce("classes", F.lit("")), ","), F.col("f")), "t").otherwise("f")
    own = F.decode(F.unhex(F.lpad(F.hex("cp"), 8, "0")), "utf-32")
    answer = F.when(~F.col("f").isin(*CASES), member)
    for c in held:
        answer = F.coalesce(answer, F.when(F.col("f") == c, F.coalesce(F.col(c), own)))
    d = met.withColumn("answer", answer)
    o, n = F.col("answer").eqNullSafe(F.col("o")), F.col("answer").eqNullSafe(F.col("n"))
    return d.select("cp", "f", "answer", F.when(o & n, "both").when(o, "old").when(n, "new").otherwise("neither").alias("like"))


# The last code point, the surrogates, and the last code point of each length in UTF-8.
LAST, SURROGATES, LENGTHS = 0x10FFFF, (0xD800, 0xDFFF), (0x7F, 0x7FF, 0xFFFF)


def endpoints(ranges: DataFrame) -> DataFrame:
    """(cp, kind): ends of disjoint ranges (lo, hi), ends of the gaps between them, and the ends of UTF-8 lengths; without U+0000 and surrogates."""
    own = Window.orderBy("lo")  # at most 1.1 million ranges of code points, whatever the input
    held = ranges.withColumn("_next", F.coalesce(F.lead("lo").over(own), F.lit(LAST + 1))).withColumn("_first", F.lag("hi").over(own).isNull())
    ends = F.array(F.struct(F.col("lo").alias("cp"), F.lit("first").alias("kind")), F.struct(F.col("hi").alias("cp"), F.lit("last").alias("kind")))
    after = F.when(F.col("_next") > F.col("hi") + 1, F.array(F.struct((F.col("hi") + 1).alias("cp"), F.lit("gap first").alias("kind")), F.struct((F.col("_next") - 1).alias("cp"), F.lit("gap last").alias("kind"))))
    before = F.when(F.col("_first") & (F.col("lo") > 1), F.array(F.struct(F.lit(1).alias("cp"), F.lit("gap first").alias("kind")), F.struct((F.col("lo") - 1).alias("cp"), F.lit("gap last").alias("kind"))))
    empty = F.array().cast("array<struct<cp:int,kind:string>>")
    every = held.select(F.explode(F.concat(ends, F.coalesce(after, empty), F.coalesce(before, empty))).alias("e")).select("e.cp", "e.kind")
    lengths = ranges.sparkSession.createDataFrame([(c + d, "length") for c in LENGTHS for d in (0, 1)], "cp int, kind string")
    return every.unionByName(lengths).filter((F.col("cp") > 0) & ~F.col("cp").between(*SURROGATES)).distinct()


def finding_groups(findings: DataFrame) -> DataFrame:
    """(locale, grp, n): locales with the same set of findings are one group, named by its least locale. Sets are named by a hash that
    combines before the shuffle."""
    per = findings.select("locale", "finding").distinct().groupBy("locale").agg(sum_hash(F.col("finding")).alias("_d"))
    groups = per.groupBy("_d").agg(F.min("locale").alias("grp"), F.count("*").alias("n"))
    return per.join(groups, "_d").select("locale", "grp", "n")


def validate(runs: DataFrame, told: DataFrame, groups: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(locale, problem), a row a violation, none for a valid report: what :func:`strings.run_problems` finds in the runs (locale, seq, first, last) of measured strings,
    counts ``told`` (locale, n) that are missing or not those of the runs, and ``groups`` (locale) that are not the verdicts' changed locales."""
    own = run_problems(runs).select("locale", "problem")
    known = runs.filter("locale is not null and seq is not null and first.value is not null and last.value is not null")
    held = known.groupBy("locale").agg(F.sum(F.col("last.value") - F.col("first.value") + 1).alias("_n"))
    named = told.filter("locale is not null")
    counts = named.join(held, "locale", "full_outer").filter(F.coalesce("n", F.lit(0)) != F.coalesce("_n", F.lit(0))).select("locale", F.lit("count differs").alias("problem"))
    none = told.filter("locale is null or n is null").select("locale", F.lit("null").alias("problem"))
    lacks = groups.filter("locale is null").select("locale", F.lit("null").alias("problem")).unionByName(verdicts.filter("locale is null or verdict is null").select("locale", F.lit("null").alias("problem")))
    changed, grouped = verdicts.filter("verdict = 'changed' and locale is not null").select("locale").distinct(), groups.filter("locale is not null").select("locale").distinct()
    missing = changed.join(grouped, "locale", "left_anti").withColumn("problem", F.lit("changed and in no group"))
    extra = grouped.join(changed, "locale", "left_anti").withColumn("problem", F.lit("in a group and not changed"))
    twice = groups.filter("locale is not null").groupBy("locale").agg(F.count("*").alias("_n")).filter("_n > 1").select("locale", F.lit("in two groups").alias("problem"))
    return own.unionByName(counts).unionByName(none).unionByName(lacks).unionByName(missing).unionByName(extra).unionByName(twice)


def report(verdicts: DataFrame, rules: DataFrame, groups: DataFrame) -> DataFrame:
    """P5: (locale, document): one nested document a locale, with a state for every part that is absent, so nothing in it is null."""
    r = rules.select("locale", F.col("state").alias("_s"), F.coalesce("why", F.lit("")).alias("_w"))
    d = verdicts.join(r, "locale", "left").join(groups.select("locale", "grp", F.col("n").alias("_n")), "locale", "left")
    document = F.struct(
        F.col("locale"), F.col("verdict"),
        F.struct(F.coalesce("_s", F.lit("no rules")).alias("state"), F.coalesce("_w", F.lit("")).alias("why")).alias("rules"),
        F.struct(F.when(F.col("grp").isNull(), "not grouped").otherwise("grouped").alias("state"), F.coalesce("grp", F.lit("")).alias("of"), F.coalesce("_n", F.lit(0)).alias("n")).alias("group"),
    )
    return d.select("locale", F.to_json(document).alias("document"))
