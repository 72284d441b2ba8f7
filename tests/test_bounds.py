"""Bounds and ranges as tables, dominance counts, measured strings, and the smaller level, against plain Python."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from lexishift.functions.keys import OTHER, Profile, key, levels
from lexishift.functions.keys import PROFILES as P
from lexishift.operators import bounds as R
from lexishift.operators import order as O
from lexishift.operators import strings as T

NEW, BYTES = P["vw_new"], P["bytes"]
BOUND = "part string, lo string, hi string"


def small_ranges(monkeypatch, rows=50):
    """Tables of a few hundred rows in many ranges, as large tables have them."""
    monkeypatch.setattr(O, "FEW_ROWS", rows), monkeypatch.setattr(O, "TOGETHER", 3)


def test_open_ends_gaps_overlaps_and_nulls(spark, monkeypatch):
    small_ranges(monkeypatch, 2)
    parts = [("low", None, "c"), ("mid", "c", "f"), ("late", "h", "m"), ("over", "j", "k"), ("high", "p", None)]
    df = spark.createDataFrame([(w, "x") for w in ["", "a", "c", "ez", "f", "g", "h", "j", "jz", "k", "lz", "m", "p", "zz", None, "a"]], "w string, part string")
    got = sorted((str(r.w), r.routed) for r in R.route_by(df, spark.createDataFrame(parts, BOUND), BYTES).collect())
    assert got == sorted([("", "low"), ("a", "low"), ("a", "low"), ("c", "mid"), ("ez", "mid"), ("f", "none"), ("g", "none"), ("h", "late"), ("j", "over"), ("jz", "over"), ("k", "none"), ("lz", "none"), ("m", "none"), ("p", "high"), ("zz", "high"), ("None", None)])
    none = spark.createDataFrame([], BOUND)
    assert {r.routed for r in R.route_by(df, none, BYTES).collect()} == {"none", None}


def test_a_hundred_thousand_partitions(spark):
    """Each value goes to the partition that a binary search finds; every seventh is missing."""
    starts = [f"{i:06d}" for i in range(0, 600_000, 6)]
    i = F.col("id")
    name = lambda x: F.lpad(x.cast("string"), 6, "0")
    parts = spark.range(100_000).filter(i % 7 != 3).select(name(i * 6).alias("part"), F.when(i > 0, name(i * 6)).alias("lo"), F.when(i < 99_999, name(i * 6 + 6)).alias("hi"))
    values = spark.range(0, 600_000, 31).select(name(i).alias("w"))
    got = {r.w: r.routed for r in R.route_by(values, parts, BYTES).collect()}
    assert len(got) == 19355
    for w, routed in got.items():
        at = bisect.bisect_right(starts, w) - 1
        assert routed == ("none" if at % 7 == 3 else starts[at])


def test_lookups_and_repartition(spark):
    parts = spark.createDataFrame([("a", None, "m"), ("z", "m", None)], BOUND)
    df = spark.createDataFrame([("b", "a"), ("b", "z"), ("n", "a"), ("n", "a"), ("q", "z"), (None, None)], "w string, part string")
    lost = R.pruning_loss(df, parts, BYTES, spark.createDataFrame([("b",), ("n",), ("new",), ("b",), (None,)], "v string"))
    assert {tuple(r) for r in lost.collect()} == {("b", "a", 1, 2), ("n", "z", 2, 2), ("new", "z", 0, 0)}
    fixed, counts = R.repartition_by(df, parts, BYTES)
    assert R.misplaced_by(fixed, parts, BYTES).count() == 0 and R.misplaced_by(df, parts, BYTES).count() == 3
    assert {tuple(r) for r in counts.collect()} == {("a", 3, 2, 1, 2), ("z", 2, 3, 2, 1), (None, 1, 1, 0, 0)}


@pytest.mark.parametrize("width,fan,kind", [(8, 2, "random"), (7, 16, "near"), (1, 3, "reversed"), (1000, 16, "random")])
def test_dominance_counts(spark, monkeypatch, width, fan, kind):
    monkeypatch.setattr(O, "FAN", fan)
    rng = random.Random(width)
    n = 211
    new = list(range(1, n + 1))
    if kind == "random":
        rng.shuffle(new)
    elif kind == "reversed":
        new.reverse()
    else:
        new = sorted(new, key=lambda x: x + rng.uniform(0, 20))
        new = [r + 1 for r in sorted(range(n), key=new.__getitem__)]
    points = list(zip(range(1, n + 1), new, strict=True))
    cursors = [(i, rng.randrange(0, n + 1), rng.randrange(0, n + 1)) for i in range(60)]
    got = O.dominance_counts(spark.createDataFrame(points, "old long, new long"), spark.createDataFrame(cursors, "q long, old long, new long"), n, width)
    want = {q: sum(a <= o and b > m for a, b in points) for q, o, m in cursors}
    assert {q: m for q, m in want.items() if m} == {r.q: r.n for r in got.collect() if r.n}


def test_page_drift_makes_rows_in_proportion_to_its_table(spark, monkeypatch):
    """Counts a level, for twice the table, are about twice as many, even where every row moves far."""
    made = {}
    for n in (4000, 8000):
        points = spark.range(1, n + 1).select(F.col("id").alias("old"), (F.col("id") * 1103 % (n + 1)).alias("new"))
        width, rows = 250, 0
        block = width
        while block < n:
            rows += points.select(F.floor((F.col("old") - 1) / (block * O.FAN)), F.floor((F.col("new") - 1) / width), F.pmod(F.floor((F.col("old") - 1) / block), F.lit(O.FAN))).distinct().count()
            block *= O.FAN
        made[n] = rows
    assert made[8000] <= 8000 and made[4000] <= 4000


def test_losses_of_every_range(spark, monkeypatch):
    small_ranges(monkeypatch)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("vwaeW") for _ in range(rng.randrange(1, 5)))
    rows = [(rng.randrange(12), word()) for _ in range(600)]
    stats = [(b, word(), word()) for b in range(12)]  # bounds that need not hold their rows, nor be in order
    ranges = [(i, word(), word()) for i in range(80)] + [(99, "v", "v"), (98, None, "w")]
    df, st, ra = spark.createDataFrame(rows, "block int, w string"), spark.createDataFrame(stats, "block int, lo string, hi string"), spark.createDataFrame(ranges, "rid int, lo string, hi string")
    every = {w for _, w in rows} | {x for s in stats for x in s[1:]} | {x for r in ranges for x in r[1:] if x}
    k = {r.w: r.k for r in spark.createDataFrame([(w,) for w in every], "w string").select("w", key(F.col("w"), NEW).alias("k")).collect()}
    of = {b: (k[lo], k[hi]) for b, lo, hi in stats}
    lost = lambda lo, hi: 0 if lo is None else sum(k[lo] <= k[w] < k[hi] and not (of[b][1] >= k[lo] and of[b][0] < k[hi]) for b, w in rows)
    got = {r.rid: r.n_lost for r in R.skip_losses(df, st, ra, "block", NEW).collect()}
    assert got == {i: lost(lo, hi) for i, lo, hi in ranges} and sum(got.values()) > 0


def test_ranks_over_many_ranges(spark, monkeypatch):
    small_ranges(monkeypatch, 20)
    df = spark.range(900).select((F.col("id") * 7919 % 1000).cast("string").alias("w"))
    got = [r.w for r in O.rank(df, key(F.col("w"), BYTES)).orderBy("rank").collect()]
    assert got == sorted(got) and len(got) == 900
    pairs = {(r.prev, r.w) for r in O.neighbours(df, BYTES).collect()}
    assert pairs == set(zip(got, got[1:], strict=False))
    moved = O.inversion_participants(df, BYTES, Profile("turned", (("0123456789", "9876543210"),)))
    assert moved.count() > 800


@pytest.mark.parametrize("how", ["sum", "last", "max", "min"])
def test_what_earlier_ranges_hand_on(spark, monkeypatch, how):
    monkeypatch.setattr(O, "TOGETHER", 4)
    rng = random.Random(1)
    values = [(i, None if rng.random() < 0.3 else rng.randrange(100)) for i in range(-1, 30)]
    for down in ((False,) if how == "last" else (False, True)):
        got = {r["_bucket"]: r.x for r in O.before(spark.createDataFrame(values, "_bucket int, v int"), "v", "x", how, descending=down).collect()}
        for i, _ in values:
            earlier = [v for j, v in values if (j > i if down else j < i) and v is not None]
            want = sum(earlier) if how == "sum" else (earlier[-1] if how == "last" else max(earlier) if how == "max" else min(earlier)) if earlier else None
            assert got[i] == want


def test_byte_strings_collapse_into_runs(spark, monkeypatch):
    small_ranges(monkeypatch, 2)
    names = ["U+0041", "U+0042", "U+0044", "bytes 41", "bytes 42", "bytes 00 42", "bytes 00 43", "bytes 00 43", "bytes FF", "bytes " + " ".join(["FF"] * 15), "bytes " + " ".join(["FF"] * 14 + ["FE"]), "U+110000", "bytes", "x", None, "bytes 43"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", T.measured(F.col("n")).alias("x"))
    assert {r.n for r in df.filter("x is null").collect()} == {"U+110000", "bytes", "x", None}
    got = {(r["first"].kind, r["first"].len, int(r["first"].value), int(r["last"].value)) for r in T.runs_of(df, "x").collect()}
    top = 256**15 - 1
    assert got == {(0, 1, 65, 66), (0, 1, 68, 68), (1, 1, 0x41, 0x43), (1, 2, 0x42, 0x43), (1, 1, 255, 255), (1, 15, top - 1, top)}
    points = spark.createDataFrame([(c,) for c in (1, 2, 3, 5, 5, 4096, 4095, 4097)], "cp int")
    assert {tuple(r) for r in T.runs(points).collect()} == {(1, 3), (5, 5), (4095, 4097)}


def test_runs_of_mixed_kind_wrong_order_overlap_or_nulls_are_told(spark):
    at = lambda name: T.measured(F.lit(name))
    runs = [
        ("good", 0, "U+0041", "U+0043"), ("good", 1, "bytes 41", "bytes 42"), ("good", 2, "bytes 00 01", "bytes 00 01"), ("mixed", 0, "U+0041", "bytes 42"), ("long", 0, "bytes 41", "bytes 00 42"), ("empty", 0, "U+0044", "U+0043"),
        ("order", 0, "bytes 41", "bytes 42"), ("order", 1, "U+0041", "U+0043"), ("overlap", 0, "U+0041", "U+0043"), ("overlap", 1, "U+0043", "U+0044"), ("null", 0, "U+0041", "bad"), ("twice", 0, "U+0041", "U+0041"), ("twice", 0, "U+0051", "U+0051"),
    ]
    df = spark.createDataFrame(runs, "locale string, seq int, a string, b string").select("locale", "seq", T.measured(F.col("a")).alias("first"), T.measured(F.col("b")).alias("last"))
    assert {tuple(r) for r in T.run_problems(df).collect()} == {
        ("mixed", 0, "ends of another kind or length"), ("long", 0, "ends of another kind or length"), ("empty", 0, "empty run"), ("order", 1, "run not after the one before"),
        ("overlap", 1, "run not after the one before"), ("null", 0, "null"), ("twice", 0, "two runs of one place"),
    }


def test_characters_smaller_than_case(spark):
    p = Profile("marks", P["same"].levels, small="-']^")
    pairs = spark.createDataFrame([("coop", "co-op"), ("co-op", "coo-p"), ("co-op", "co'op"), ("co-op", "Co-op"), ("co-op", "cöop"), ("a]", "a^"), ("abc", "abd")], "prev string, w string")
    assert [r.level for r in O.told_apart(pairs, p).collect()] == ["smaller", "smaller", "smaller", "case", "accent", "smaller", "letter"]
    row = spark.range(1).select(levels(F.lit("c-o"), p)[3].alias("l")).first()
    assert row.l == OTHER + "-" + OTHER
    ordered = [r.w for r in spark.createDataFrame([(w,) for w in ("coop", "co-op", "c-oop", "coops", "Coop")], "w string").orderBy(key(F.col("w"), p)).collect()]
    assert ordered == ["c-oop", "co-op", "coop", "Coop", "coops"]
