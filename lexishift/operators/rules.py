"""Tables of sort rules, character sets and names compared between an old and a new side.

Every comparison answers same, differs, or not compared and why; a missing side is never an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexishift.operators.graphs import closure


def sum_hash(text: Column) -> Column:
    """An aggregate that names a multiset of strings: both halves of their MD5s, each summed exactly (so it combines before a shuffle)."""
    half = lambda at: F.sum(F.conv(F.substring(F.md5(text), at, 16), 16, 10).cast("decimal(28,0)"))  # noqa: E731  a sum has ten digits more
    return F.concat_ws(":", half(1).cast("string"), half(17).cast("string"))


def rules_digest(rules: DataFrame) -> DataFrame:
    """L1: (side, locale, digest, n) over statements with their place; file and line are left out. The digest is a sum, so a locale
    with a third of all statements combines before the shuffle."""
    return rules.groupBy("side", "locale").agg(sum_hash(F.concat_ws("|", F.col("seq").cast("string"), "stmt")).alias("digest"), F.count("*").alias("n"))


def both_sides(df: DataFrame, on: list[str]) -> DataFrame:
    """The old and the new rows of a (side, ...) table beside each other, null where a side has none."""
    rest = [c for c in df.columns if c not in ("side", *on)]
    a, b = (df.filter(F.col("side") == s).select(*on, F.lit(True).alias(f"in_{s}"), *[F.col(c).alias(f"{s}_{c}") for c in rest]) for s in ("old", "new"))
    return a.join(b, on, "full_outer")


def compare_rules(rules: DataFrame, doubts: DataFrame | None = None, aliases: DataFrame | None = None, source=None) -> DataFrame:
    """L2: (locale, state, why) for every name of either side, doubts first.

    Not compared, with the first reason that holds: the name has no rules on a side; a ``doubt`` (side, locale, why) stands against either side's
    reading (the old side's first). ``aliases`` (side, alias, locale) are names too, compared by the rules of the file (``source`` over the locale) that each
    side builds them from: not compared where one side lacks the alias or has no rules for its file. An alias spelled as a name with rules is that name.
    """
    held = rules_digest(rules)
    d = both_sides(held, ["locale"])
    lacks = F.when(F.col("in_old").isNull(), "only on the new side").when(F.col("in_new").isNull(), "only on the old side")
    if doubts is None:
        d = d.withColumn("_doubt", F.lit(None).cast("string"))
    else:
        order = F.when(F.col("side") == "old", 0).otherwise(1)
        told = doubts.groupBy("locale").agg(F.min(F.struct(order.alias("o"), "side", "why")).alias("x")).select("locale", F.concat_ws(": ", F.concat("x.side", F.lit(" side")), "x.why").alias("_doubt"))
        d = d.join(told, "locale", "left")
    alike = (F.col("old_digest") == F.col("new_digest")) & (F.col("old_n") == F.col("new_n"))
    why = F.coalesce(lacks, "_doubt")
    out = d.select("locale", F.when(why.isNotNull(), "not compared").when(alike, "same").otherwise("differs").alias("state"), why.alias("why"))
    if aliases is None:
        return out
    # an alias is compared as a name whose sides are its files' sides
    built = aliases.select("side", F.col("alias").alias("locale"), source("locale").alias("file")).groupBy("side", "locale").agg(F.min("file").alias("file"))
    built = built.join(d.select("locale"), "locale", "left_anti")
    mine = held.select("side", F.col("locale").alias("file"), "digest", "n")
    doubted = (doubts if doubts is not None else rules.select("side", "locale", F.lit("").alias("why")).limit(0)).groupBy("side", "locale").agg(F.min("why").alias("doubt"))
    sides = built.join(mine, ["side", "file"], "left").join(doubted.withColumnRenamed("locale", "file"), ["side", "file"], "left")
    e = both_sides(sides.select("side", "locale", "file", "digest", "n", "doubt"), ["locale"])
    lacks = F.when(F.col("in_old").isNull(), "an alias on the new side only").when(F.col("in_new").isNull(), "an alias on the old side only")
    for s_ in ("old", "new"):
        lacks = F.coalesce(lacks, F.when(F.col(f"{s_}_digest").isNull(), F.concat(F.lit("built from "), F.col(f"{s_}_file"), F.lit(f", which has no rules on the {s_} side"))))
    for s_ in ("old", "new"):
        lacks = F.coalesce(lacks, F.when(F.col(f"{s_}_doubt").isNotNull(), F.concat(F.lit(f"{s_} side: "), F.col(f"{s_}_doubt"))))
    alike = (F.col("old_digest") == F.col("new_digest")) & (F.col("old_n") == F.col("new_n"))
    named = e.filter("old_digest is not null or new_digest is not null").select("locale", F.when(lacks.isNotNull(), "not compared").when(alike, "same").otherwise("differs").alias("state"), lacks.alias("why"))
    return out.unionByName(named)


def changed_statements(rules: DataFrame) -> DataFrame:
    """Statements of one side only, as multisets: each with how often it is missing on the other."""
    net = rules.groupBy("locale", "stmt").agg(F.sum(F.when(F.col("side") == "old", 1).otherwise(-1)).alias("net")).filter("net <> 0")
    return net.select("locale", "stmt", F.when(F.col("net") > 0, "removed").otherwise("added").alias("change"), F.abs("net").cast("long").alias("times"))


def changed_chars(rules: DataFrame) -> DataFrame:
    """L3: (locale, every_rule, chars, why): per locale the characters on changed statements, and whether such a statement steers others.

    ``chars`` is null, with a reason, where a changed statement's own characters are not known (null); it is empty where the changed statements name none."""
    changed = changed_statements(rules).select("locale", "stmt").distinct()
    on = rules.join(changed, ["locale", "stmt"])
    chars = on.select("locale", F.explode("chars").alias("c")).distinct().groupBy("locale").agg(F.array_sort(F.collect_list("c")).alias("_c"))  # code points at most
    d = on.groupBy("locale").agg(F.bool_or("steers").alias("every_rule"), F.bool_or(F.col("chars").isNull()).alias("_unknown")).join(chars, "locale", "left")
    none = F.array().cast(rules.schema["chars"].dataType)
    return d.select("locale", "every_rule", F.when(~F.col("_unknown"), F.coalesce("_c", none)).alias("chars"), F.when(F.col("_unknown"), "the characters of a changed statement are not known").alias("why"))


def inventory_diff(names: DataFrame, renames: DataFrame) -> DataFrame:
    """(name, status) of names on one side only: added, removed, or renamed to another."""
    d = both_sides(names.distinct(), ["name"]).filter(F.col("in_old").isNull() | F.col("in_new").isNull())
    moved = d.join(renames.select(F.col("old").alias("name"), F.col("new").alias("to")), "name", "left")
    return moved.select("name", F.when(F.col("in_old").isNull(), "added").when(F.col("to").isNotNull(), F.concat(F.lit("renamed to "), "to")).otherwise("removed").alias("status"))


def delta_hits(delta: DataFrame, ranges: DataFrame, width: int = 256) -> DataFrame:
    """Ranges (name, lo, hi) that hold a character of the delta. Both sides meet by block of code points, so no nested loop."""
    cut = ranges.select("name", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))).alias("b"))
    points = delta.select("cp", F.floor(F.col("cp") / width).alias("b")).distinct()
    return cut.join(points, "b").filter("cp between lo and hi").select("name", "cp").distinct()


# The states of a character map, strongest first.
STATES = ("changed", "transliteration", "not compared", "transliteration not compared")


def strongest_state(found: DataFrame, by: str = "source", state: str = "state") -> DataFrame:
    """One state a source, the strongest of several."""
    order = F.array(*map(F.lit, STATES))
    return found.groupBy(by).agg(F.min_by(state, F.array_position(order, F.col(state))).alias(state))


def left_out(found: DataFrame, listed: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """(what is not listed elsewhere, what is)."""
    return found.join(listed, on, "left_anti"), found.join(listed, on, "left_semi")


def group_alike(answers: DataFrame, by: list[str], name: str) -> DataFrame:
    """(*by, name, grp, n): names with one answer are one group, named by its least name; a row a name, so a group of any size is spread over rows."""
    key = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    held = answers.select(*by, name).distinct()
    groups = held.groupBy(*by).agg(F.min(name).alias("grp"), F.count("*").alias("n"))
    return held.alias("a").join(groups.alias("b"), key).select(*[f"a.{c}" for c in by], f"a.{name}", "grp", "n")


def attribute_diff(df: DataFrame, on: str, value: str) -> DataFrame:
    """One value per name compared: same, changed, or on one side only."""
    d = both_sides(df.select("side", on, value), [on])
    return d.select(on, F.when(F.col("in_old").isNull(), "only new").when(F.col("in_new").isNull(), "only old").when(F.col(f"old_{value}").eqNullSafe(F.col(f"new_{value}")), "same").otherwise("changed").alias("status"))


def nearest_roots(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(src, root) for the roots that src reaches without walking past another root."""
    return closure(edges, stop=roots.select(F.col("root").alias("dst")).distinct()).join(roots.select(F.col("root").alias("dst")).distinct(), "dst", "left_semi").select("src", F.col("dst").alias("root"))


def alias_expand(names: DataFrame, aliases: DataFrame, source: Column) -> DataFrame:
    """(name, listed, why): the listed names and the aliases (side, alias, locale) whose target (``source`` over ``aliases``) is one of them on either side.

    ``why`` says of an alias that one side lacks, or that leads elsewhere there, that it is not compared."""
    to = aliases.select("side", F.col("alias").alias("name"), source.alias("_to")).distinct()
    met = to.join(names.select(F.col("name").alias("_to")).distinct(), "_to", "left_semi").select("name").distinct()
    sides = both_sides(to.join(met, "name", "left_semi").groupBy("side", "name").agg(F.min("_to").alias("to")), ["name"])
    why = F.when(F.col("in_old").isNull(), "not compared: an alias on the new side only").when(F.col("in_new").isNull(), "not compared: an alias on the old side only").when(F.col("old_to") != F.col("new_to"), "not compared: built from another file on each side")
    found = sides.select("name", F.lit(False).alias("listed"), why.alias("why"))
    listed = names.select("name").distinct().select("name", F.lit(True).alias("listed"), F.lit(None).cast("string").alias("why"))
    return listed.unionByName(found.join(listed.select("name"), "name", "left_anti"))


def affected_builds(builds: DataFrame, edges: DataFrame, hits: DataFrame) -> DataFrame:
    """(source, charmap, n_chars, via) for builds whose files, own or reached through ``edges``, name a changed character of their charmap."""
    reach = closure(edges).unionByName(builds.select("source").distinct().select(F.col("source").alias("src"), F.col("source").alias("dst"))).distinct()
    on = builds.distinct().join(reach, F.col("source") == F.col("src")).join(hits.distinct().withColumnRenamed("charmap", "_map"), (F.col("dst") == F.col("file")) & (F.col("charmap") == F.col("_map")))
    return on.groupBy("source", "charmap").agg(F.count_distinct("cp").alias("n_chars"), F.array_join(F.array_sort(F.collect_set("dst")), ",").alias("via"))


def charmap_of(declared: DataFrame) -> DataFrame:
    """The one file that declares a codeset; null where several do."""
    per = declared.groupBy("codeset").agg(F.min("file").alias("lo"), F.max("file").alias("hi"))
    return per.select("codeset", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("file"))


def rules_beside(verdicts: DataFrame, compared: DataFrame, digests: DataFrame | None = None) -> DataFrame:
    """Each verdict with the state of its locale's rules and ``beside``, why they stand there or not; ``no rules`` where the comparison has no such name.

    ``digests`` (locale, measured, compared) name the measurement that the verdict and the one that the rules rest on: where they differ or one is missing, the state
    is ``refused``, as rules of another measurement say nothing about the verdict."""
    d = verdicts.join(compared.select("locale", "state"), "locale", "left").withColumn("state", F.coalesce("state", F.lit("no rules")))
    if digests is None:
        return d
    held = digests.groupBy("locale").agg(F.min("measured").alias("_a"), F.max("measured").alias("_a2"), F.min("compared").alias("_b"), F.max("compared").alias("_b2"))
    a, b = F.col("_a"), F.col("_b")
    why = F.when(a.isNull() | b.isNull(), "a digest is missing").when((a != F.col("_a2")) | (b != F.col("_b2")), "several measurements").when(a != b, "the rules belong to another measurement")
    met = d.join(held, "locale", "left").withColumn("beside", why)
    return met.select(*verdicts.columns, F.when(F.col("beside").isNotNull(), "refused").otherwise(F.col("state")).alias("state"), "beside")
