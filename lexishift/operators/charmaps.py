"""Character maps as tables of ranges: compared by a sweep over their ends, and used to decode bytes of any encoding.

A row (lo, hi, bytes) gives the code points lo to hi the values from ``bytes`` (hexadecimal) on, counted up in as many bytes. A
row of one code point (lo = hi) goes before a range; of several such rows for one code point the least bytes count. Of ranges that overlap, that which
begins last counts, up to where the next begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexishift.functions.keys import Profile, sign
from lexishift.operators.elements import longest_match
from lexishift.operators.rules import both_sides, sum_hash


def mapped(charmap: DataFrame, by: list[str]) -> DataFrame:
    """(*by, pos, single, range): what begins at each place where a mapping begins or has just ended.

    ``single`` is (size, off) of the single row at ``pos``; ``range`` (hi, size, off) of the range that begins there. ``off`` is value minus code point, so two
    mappings that give a piece the same bytes have the same ``size`` and ``off``, however they are cut.
    """
    value = F.conv("bytes", 16, 10).cast("long")
    of = F.struct((F.length("bytes") / 2).cast("int").alias("size"), (value - F.col("lo")).alias("off"))
    rows = charmap.filter("lo <= hi").select(*by, "lo", "hi", of.alias("m"), (F.col("lo") == F.col("hi")).alias("one"))
    events = F.array(
        F.struct(F.col("lo").cast("long").alias("pos"), F.when(F.col("one"), F.col("m")).alias("single"), F.when(~F.col("one"), F.struct(F.col("hi").cast("long").alias("hi"), "m.size", "m.off")).alias("range")),
        F.struct((F.col("hi") + 1).cast("long").alias("pos"), F.lit(None).cast("struct<size:int,off:bigint>").alias("single"), F.lit(None).cast("struct<hi:bigint,size:int,off:bigint>").alias("range")),
    )
    return rows.select(*by, F.explode(events).alias("e")).select(*by, "e.*").groupBy(*by, "pos").agg(F.min("single").alias("single"), F.max("range").alias("range"))


def pieces(charmap: DataFrame) -> DataFrame:
    """(charmap, lo, hi, old, new): maximal pieces between the ends of both sides' rows, with each side's (size, off), null where it has none.

    Rows of one map are at most twice its code points, so a map is one window; maps meet nowhere."""
    side = lambda s: mapped(charmap.filter(F.col("side") == s), ["charmap"]).select("charmap", "pos", F.col("single").alias(f"{s}_single"), F.col("range").alias(f"{s}_range"))
    own = Window.partitionBy("charmap").orderBy("pos")
    cuts = side("old").join(side("new"), ["charmap", "pos"], "full_outer").withColumn("hi", F.lead("pos").over(own) - 1)
    until = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def at(s: str) -> Column:
        last = F.last(f"{s}_range", ignorenulls=True).over(until)
        return F.coalesce(F.col(f"{s}_single"), F.when(last["hi"] >= F.col("pos"), F.struct(last["size"].alias("size"), last["off"].alias("off"))))

    return cuts.select("charmap", F.col("pos").alias("lo"), "hi", at("old").alias("old"), at("new").alias("new")).filter("hi is not null and (old is not null or new is not null)")


def charmap_delta(charmap: DataFrame) -> DataFrame:
    """(charmap, cp, change): code points with other bytes, added or removed, exact over singles and ranges, whatever rows either side
    is cut into. Maps whose rows agree are left out first, and only pieces that differ are expanded."""
    digest = charmap.groupBy("side", "charmap").agg(sum_hash(F.concat_ws("|", "lo", "hi", "bytes")).alias("d"))
    differ = both_sides(digest, ["charmap"]).filter(~F.col("old_d").eqNullSafe(F.col("new_d"))).select("charmap")
    moved = pieces(charmap.join(differ, "charmap", "left_semi")).filter(~F.col("old").eqNullSafe(F.col("new")))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("other bytes")
    return moved.select("charmap", F.explode(F.sequence(F.col("lo").cast("int"), F.col("hi").cast("int"))).alias("cp"), change.alias("change"))


def byte_sequences(charmap: DataFrame, by: list[str]) -> DataFrame:
    """(*by, bytes, cp): every byte sequence that a map defines, at most one code point (the least) each; 1.1 million rows a map at most."""
    own = Window.partitionBy(*by).orderBy("pos")
    until = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last("range", ignorenulls=True).over(until)
    cut = mapped(charmap, by).withColumn("hi", F.lead("pos").over(own) - 1).withColumn("m", F.coalesce("single", F.when(last["hi"] >= F.col("pos"), F.struct(last["size"].alias("size"), last["off"].alias("off")))))
    every = cut.filter("m is not null and hi is not null").select(*by, "m", F.explode(F.sequence("pos", "hi")).alias("cp"))
    digits = F.lpad(F.hex(F.col("cp") + F.col("m.off")), 2 * F.col("m.size"), "0")
    return every.select(*by, digits.alias("bytes"), "cp").groupBy(*by, "bytes").agg(F.min("cp").cast("int").alias("cp"))


def decode_by_charmap(df: DataFrame, hexed: str, encoding: str, charmap: DataFrame) -> DataFrame:
    """``df`` with ``text`` and ``state`` of hexadecimal bytes in any encoding of ``charmap`` (charmap, lo, hi, bytes).

    ``decoded``; ``not convertible`` where a sequence is cut short or not in the map; ``not known`` where there is no such map. Null bytes have no text and no state.
    Distinct strings are cut into the map's sequences, the longest first, which meet the table in a join.
    """
    asked = df.select(F.col(encoding).alias("_e"), F.upper(hexed).alias("_s")).filter("_s is not null").distinct()
    table = byte_sequences(charmap.withColumnRenamed("charmap", "_e"), ["_e"]).select("_e", F.col("bytes").alias("element"), (F.length("bytes") / 2).cast("int").alias("size"), F.struct("cp").alias("payload"))
    known = charmap.select(F.col("charmap").alias("_e"), F.lit(True).alias("_known")).distinct()
    cut = longest_match(asked.withColumn("units", F.regexp_extract_all("_s", F.lit("..?"), F.lit(0))), table, ["_e"])
    code = lambda p: F.decode(F.unhex(F.lpad(F.hex(p["payload"]["cp"]), 8, "0")), "utf-32")
    text = F.when(F.forall("steps", lambda p: p["payload"].isNotNull()), F.array_join(F.transform("steps", code), ""))
    told = cut.select("_e", "_s", text.alias("_text")).join(known, "_e", "left")
    told = told.select("_e", "_s", F.when(F.col("_known"), F.col("_text")).alias("text"), F.when(F.col("_known").isNull(), "not known").when(F.col("_text").isNull(), "not convertible").otherwise("decoded").alias("state"))
    return df.join(told, F.col(encoding).eqNullSafe(F.col("_e")) & (F.upper(hexed) == F.col("_s")), "left").drop("_e", "_s")


def answer_binary_tests(tests: DataFrame, charmap: DataFrame, p: Profile, encoding: str = "encoding") -> DataFrame:
    """V5: ``tests`` (encoding, ah, bh in hexadecimal) with ``answer`` under a profile and ``state``; a pair that cannot be decoded has no answer."""
    both = tests
    for h, t in (("ah", "_a"), ("bh", "_b")):
        both = decode_by_charmap(both, h, encoding, charmap).withColumnRenamed("text", t).withColumnRenamed("state", f"{t}_state")
    order = F.array(F.lit("not known"), F.lit("not convertible"), F.lit("decoded"))
    state = F.element_at(order, F.least(F.array_position(order, F.col("_a_state")), F.array_position(order, F.col("_b_state"))).cast("int"))
    return both.withColumn("state", state).withColumn("answer", F.when(F.col("state") == "decoded", sign(F.col("_a"), F.col("_b"), p))).drop("_a", "_b", "_a_state", "_b_state")
