"""Near duplicates by min-max hashing: keep the minimum and the maximum under each permutation.

A text's set is its distinct five-word shingles (64-bit, from 64-bit word hashes). Texts with equal sets are one
class, named by a number of its own (a ``doc_id`` may stand beside several texts). A class's signature has the minimum and the maximum of each of some hash functions, so half as many
evaluations give a signature of full length. Bands of ``ROWS`` values (two permutations, both ends) propose
candidates; ``plan_for`` takes as many bands as a Jaccard similarity needs to miss a pair with probability under 1e-5.
Links are confirmed by intersecting full sets.

No bucket's pairs are written out. In each round every bucket with more than one component sends its members
to one pivot (the member whose buckets are largest, so the text that others were copied from), links that
hold are merged into components, and buckets that have become one component are done. What is still open after
``ROUNDS`` rounds are mostly texts just below the similarity to their bucket's origin. Their shingles are put in
one order, rarest first: the first shingle that a linked pair shares stands so early in both sets that the rest
can still reach the similarity. Texts meet only at such a shingle, and only if their components differ. What a
variant shares with all others comes last, so it meets those that share its own changes, not the group. In
``FEW_ROUNDS`` rounds before, each meets only a few of a shingle: two large parts of one group that the pivots
have not joined thus become one component by some of their links, before all their pairs would be made.

Components are found by alternating large-star and small-star steps over written tables; nothing is collected.

Defined results: a null or empty text has an empty set, is linked with nothing and kept; a row whose
``doc_id`` is null takes no part, has a null component and is kept; repeated rows with one ``doc_id`` and one
text are one document returned as often; rows with one ``doc_id`` and different texts are linked each by its own
text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexishift.llm.storage import carried, delete, materialise, restored, workspace

WIDTH, ROWS, ROUNDS = 5, 4, 2
CONTRACT, GENERAL = 0.85, 0.8  # similarity of op2_minhash, and of near-duplicate stages
BAND_MISS, SIGNATURE_MISS = 1e-5, 1e-8
CHUNK = 1 << 15
FEW_ROUNDS, FEW = 2, 8  # rounds in which a frequent shingle's rows meet only about so many others, so that groups that hang together become one component first
MEET = 2048  # rows of one frequent shingle that meet all others of it in a task


@dataclass(frozen=True)
class Plan:
    """What follows from a similarity of ``numerator / denominator``: ``bands`` bands of two permutations miss a linked pair with
    probability under ``BAND_MISS``; it agrees in fewer than ``close`` signature values with probability under ``SIGNATURE_MISS``."""

    numerator: int
    denominator: int
    bands: int
    close: int

    @property
    def permutations(self) -> int:
        return 2 * self.bands


def plan_for(similarity: float) -> Plan:
    s = Fraction(str(similarity))
    if not 0 < s <= 1:
        raise ValueError(f"a similarity is above 0 and at most 1, not {similarity}")
    bands = 1 if s == 1 else ceil(log(BAND_MISS) / log(1 - float(s) ** ROWS))
    n, below, close = 4 * bands, 0.0, 0  # both ends of every permutation
    while close < n and (below := below + comb(n, close) * float(s) ** close * float(1 - s) ** (n - close)) < SIGNATURE_MISS:
        close += 1
    return Plan(s.numerator, s.denominator, bands, close)


def _constants(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


PLACE = _constants(WIDTH, 11)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes. Bytes split at exactly the six blanks, and lower() maps A-Z only."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < width:
        return mixed(np.array([np.bitwise_xor.reduce(mixed(h * PLACE[: len(h)]) * PLACE[: len(h)]) + np.uint64(len(h))], np.uint64))
    n = len(h) - width + 1
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total += mixed(h[i : i + n]) * PLACE[i] if i == 0 else h[i : i + n] * PLACE[i]
    return np.unique(mixed(total))


def signature(s: np.ndarray, factor: np.ndarray, shifted: np.ndarray) -> np.ndarray:
    """Minima, then maxima, of every permutation, folded to 32 bits."""
    n = len(factor)
    low, high = np.full(n, 2**64 - 1, np.uint64), np.zeros(n, np.uint64)
    for at in range(0, len(s), CHUNK):
        part = s[at : at + CHUNK]
        for i in range(n):
            x = (part ^ shifted[i]) * factor[i]
            x ^= x >> np.uint64(29)
            x *= factor[n - 1 - i]
            low[i], high[i] = min(low[i], x.min()), max(high[i], x.max())
    both = np.concatenate([low, high])
    return (both ^ (both >> np.uint64(32))).astype(np.uint32).view(np.int32)


SIGNED = "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, sig array<int>"


def _signer(permutations: int):
    factor, shifted = _constants(permutations, 12), _constants(permutations, 13)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, a, b, sigs = batch.column(0), [], [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py())
                counts.append(len(s))
                if len(s):
                    digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                    a.append(int(digest[0])), b.append(int(digest[1])), sigs.append(signature(s, factor, shifted))
                else:
                    a.append(None), b.append(None), sigs.append(None)
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column(2), pa.array(counts, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sigs, pa.list_(pa.int32()))],
                names=["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "sig"],
            )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t.as_py()).view(np.int64) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["rep", "shingles"])


def agreement(a: Column, b: Column) -> Column:
    """How many signature values two columns share."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)


def band(sig: Column, k: int, permutations: int) -> Column:
    """Band ``k``: both ends of two permutations. Permutations go in pairs, so every value is used once."""
    i, j = 2 * k, 2 * k + 1
    return F.xxhash64(F.lit(k), *[sig[x] for x in (i, j, permutations + i, permutations + j)])


def components(edges: DataFrame, root: str) -> DataFrame:
    """(node, comp) for every node of ``edges`` (u, v) but the least of each component: comp is the least node that can be reached.

    Large-star and small-star alternate until the edges no longer change; each step is a written table.
    """
    spark = edges.sparkSession
    current = materialise(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"{root}/edges-0")
    step, before = 0, None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("m").alias("u"), "v").distinct()
        step += 1
        large = materialise(large, f"{root}/edges-{step}")
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("m").alias("u"), F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v")).filter("u <> v").distinct()
        step += 1
        small = materialise(small, f"{root}/edges-{step}")
        mark = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for old in range(max(0, step - 3), step):
            if old != step:
                delete(spark, f"{root}/edges-{old}")
        current = small
        if mark == before:
            return current.select(F.col("v").alias("node"), F.col("u").alias("comp"))
        before = mark


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = CONTRACT) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_a, set_b, component_id) for every row of ``docs``; links reach ``similarity``."""
    spark: SparkSession = docs.sparkSession
    plan = plan_for(similarity)
    root = workspace(spark, "near")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.lit(5), F.col(text)).alias("text_hash"))
    signed = materialise(rows.mapInArrow(_signer(plan.permutations), SIGNED), f"{root}/signed")
    classes = signed.filter("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n"))
    classes = classes.select(F.monotonically_increasing_id().alias("rep"), "set_a", "set_b", F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"), "sig", "n")
    classes = materialise(classes, f"{root}/classes")  # the numbers hold once written

    banded = classes.select("rep", F.explode(F.array(*[F.struct(F.lit(k).cast("short").alias("k"), band(F.col("sig"), k, plan.permutations).alias("h")) for k in range(plan.bands)])).alias("b"))
    banded = banded.select("rep", F.col("b.k").alias("k"), F.col("b.h").alias("h"))
    shared = banded.groupBy("k", "h").agg(F.count("*").alias("size")).filter("size > 1")
    member = materialise(banded.join(shared, ["k", "h"]), f"{root}/member")
    weight = materialise(member.groupBy("rep").agg(F.sum("size").alias("weight")), f"{root}/weight")
    sigs = materialise(classes.join(weight, "rep", "left_semi"), f"{root}/sigs")
    texts = rows.join(sigs.select("doc_id", "text_hash", "rep"), ["doc_id", "text_hash"]).select("rep", "text")

    comp: DataFrame | None = None
    links: DataFrame | None = None
    tested: DataFrame | None = None
    open_ = member.select("k", "h", "rep").join(weight, "rep")
    early: DataFrame | None = None
    last = ROUNDS + FEW_ROUNDS
    for turn in range(last + 1):
        labelled = open_ if comp is None else open_.join(comp.select(F.col("node").alias("rep"), "comp"), "rep", "left")
        labelled = labelled.withColumn("comp", F.col("rep") if comp is None else F.coalesce("comp", "rep"))
        spread = labelled.groupBy("k", "h").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.max(F.struct("weight", (-F.col("rep")).alias("neg"))).alias("top")).filter("c0 <> c1")
        spread = materialise(spread, f"{root}/open-{turn}")
        if spread.isEmpty():  # every bucket is one component
            break
        if turn < ROUNDS:
            fresh = spread if tested is None else _untested_pivot(labelled, spread, tested)
            pivots = fresh.select("k", "h", (-F.col("top.neg")).alias("pivot"))
            pairs = labelled.join(pivots.join(spread.select("k", "h"), ["k", "h"], "left_semi"), ["k", "h"]).filter("rep <> pivot")
            if comp is not None:
                pairs = pairs.join(comp.select(F.col("node").alias("pivot"), F.col("comp").alias("pc")), "pivot", "left").filter(F.coalesce("pc", "pivot") != F.col("comp"))
            pairs = pairs.select(F.least("rep", "pivot").alias("u"), F.greatest("rep", "pivot").alias("v")).distinct()
        else:
            early = _early(labelled, spread, texts, root, plan) if early is None else early
            pairs = _early_pairs(early, comp, f"{root}/met-{turn}", plan, None if turn == last else turn)
        pairs = materialise(pairs, f"{root}/pairs-{turn}")
        if tested is not None:
            pairs = pairs.join(tested, ["u", "v"], "left_anti")
        seen = sigs.select("rep", "sig", "n")
        a = seen.select(F.col("rep").alias("u"), F.col("sig").alias("su"), F.col("n").alias("nu"))
        b = seen.select(F.col("rep").alias("v"), F.col("sig").alias("sv"), F.col("n").alias("nv"))
        agreed = pairs.join(a, "u").join(b, "v").withColumn("agree", agreement(F.col("su"), F.col("sv"))).select("u", "v", "nu", "nv", "agree")
        agreed = materialise(agreed, f"{root}/agreed-{turn}")
        if agreed.isEmpty():  # this turn's pairs have all been compared; the last turn takes what is still open
            continue
        fits = (plan.denominator * F.least("nu", "nv") >= plan.numerator * F.greatest("nu", "nv")) & (F.col("agree") >= plan.close)
        likely = agreed.filter(fits)
        found = materialise(_confirmed(likely, texts, plan), f"{root}/links-{turn}")
        marks = agreed.select("u", "v")
        tested = marks if tested is None else tested.unionByName(marks)
        tested = materialise(tested, f"{root}/tested-{turn}")
        if found.isEmpty():
            continue
        links = found if links is None else links.unionByName(found)
        comp = materialise(components(links, f"{root}/cc-{turn}"), f"{root}/comp-{turn}")

    label = classes.select("set_a", "set_b", F.col("doc_id").alias("comp"))
    if comp is not None:
        every = comp.unionByName(comp.select(F.col("comp").alias("node"), "comp").distinct())  # the least of a component has no row in ``comp``
        named = classes.select("set_a", "set_b", "rep", F.col("doc_id").alias("own")).join(every.select(F.col("node").alias("rep"), "comp"), "rep", "left")
        least = named.filter("comp is not null").groupBy("comp").agg(F.min("own").alias("least"))
        label = named.join(least, "comp", "left").select("set_a", "set_b", F.coalesce("least", "own").alias("comp"))
    out = signed.select("doc_id", "text_hash", "n_shingles", "set_a", "set_b").join(label, ["set_a", "set_b"], "left")
    return out.select("doc_id", "text_hash", "n_shingles", "set_a", "set_b", F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).alias("component_id"))


def _sets_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(rep, shingles) of those classes whose number is in ``ids`` (rep)."""
    return texts.join(ids.select("rep"), "rep", "left_semi").dropDuplicates(["rep"]).mapInArrow(_sets, "rep long, shingles array<long>")


def _untested_pivot(labelled: DataFrame, spread: DataFrame, tested: DataFrame) -> DataFrame:
    """Per open bucket the heaviest member that has not been a pivot there, by the pairs already compared."""
    done = tested.select(F.col("u").alias("rep")).unionByName(tested.select(F.col("v").alias("rep"))).groupBy("rep").agg(F.count("*").alias("times"))
    pool = labelled.join(spread.select("k", "h"), ["k", "h"], "left_semi").join(done, "rep", "left")
    rank = F.struct((-F.coalesce("times", F.lit(0))).alias("rare"), F.col("weight"), (-F.col("rep")).alias("neg"))
    return pool.groupBy("k", "h").agg(F.max(rank).alias("top"))


def _early(labelled: DataFrame, spread: DataFrame, texts: DataFrame, root: str, plan: Plan) -> DataFrame:
    """(s, rep, n, place): the shingles of open buckets' members that stand early enough in a set, rarest first, to be the first that a linked pair shares."""
    member = labelled.join(spread.select("k", "h"), ["k", "h"], "left_semi").select("rep").distinct()
    member = materialise(_sets_of(texts, member), f"{root}/open-sets")
    held = member.select("rep", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    often = held.groupBy("s").agg(F.count("*").alias("times")).filter("times > 1")
    place = F.row_number().over(Window.partitionBy("rep").orderBy(F.coalesce("times", F.lit(1)), "s"))
    early = held.join(often, "s", "left").withColumn("place", place)
    early = early.filter((F.col("times") > 1) & (plan.denominator * (F.col("n") - F.col("place") + 1) >= plan.numerator * F.col("n"))).select("s", "rep", "n", "place")
    return materialise(early, f"{root}/early")


def _early_pairs(early: DataFrame, comp: DataFrame | None, path: str, plan: Plan, few: int | None) -> DataFrame:
    """Pairs (u, v) of different components that share a shingle early enough in both sets; with ``few`` (a seed) each row meets about ``FEW`` of a shingle only.

    With ``n`` shingles each and the first shared one at places p and q (from 1, rarest first), a pair shares at most
    min(n_u - p + 1, n_v - q + 1) of them, which must reach numerator / (numerator + denominator) of n_u + n_v.
    """
    early = early.withColumn("comp", F.col("rep")) if comp is None else early.join(comp.select(F.col("node").alias("rep"), "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    met = early.groupBy("s").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.ceil(F.count("*") / (MEET if few is None else FEW)).alias("k")).filter("c0 <> c1").select("s", "k")
    early = materialise(early.join(met, "s"), path)
    # a shingle's rows are dealt into k parts of about MEET, and each part meets every row once: no task holds more of one shingle than that against it.
    # Of ``few``, parts are of about FEW rows, and meet themselves
    own = F.pmod(F.xxhash64(F.lit(few or 0), "rep"), "k")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)) if few is None else own
    a = early.select("s", own.alias("part"), F.col("rep").alias("u"), F.col("comp").alias("cu"), F.col("n").alias("nu"), F.col("place").alias("pu"))
    b = early.select("s", every.alias("part"), F.col("rep").alias("v"), F.col("comp").alias("cv"), F.col("n").alias("nv"), F.col("place").alias("pv"))
    least = plan.numerator * (F.col("nu") + F.col("nv"))
    rest = F.least(F.col("nu") - F.col("pu"), F.col("nv") - F.col("pv")) + 1
    reach = (F.col("u") < F.col("v")) & (F.col("cu") != F.col("cv")) & ((plan.numerator + plan.denominator) * rest >= least)
    return a.join(b, (a["s"] == b["s"]) & (a["part"] == b["part"]) & reach).select("u", "v").distinct()


def _confirmed(pairs: DataFrame, texts: DataFrame, plan: Plan) -> DataFrame:
    """Pairs whose full sets reach the similarity."""
    sets = _sets_of(texts, pairs.select(F.explode(F.array("u", "v")).alias("rep")).distinct())
    a = sets.select(F.col("rep").alias("u"), F.col("shingles").alias("su"))
    b = sets.select(F.col("rep").alias("v"), F.col("shingles").alias("sv"))
    common = F.size(F.array_intersect("su", "sv")).cast("long")
    both = pairs.select("u", "v", "nu", "nv").join(a, "u").join(b, "v").withColumn("common", common)
    return both.filter(plan.denominator * F.col("common") >= plan.numerator * (F.col("nu") + F.col("nv") - F.col("common"))).select("u", "v")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = GENERAL) -> DataFrame:
    """``docs`` without the near copies: of each component the row with the smallest id stays (rows that share that
    id all stay), as do rows without id or words."""
    gone = near_duplicates(docs, text, doc_id, similarity).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_gone_text")).distinct()
    rows = carried(docs, _id=doc_id, _text=text)
    met = (F.col("_id").cast("long") == F.col("_gone")) & (F.xxhash64(F.lit(5), F.col("_text")) == F.col("_gone_text"))
    return restored(rows.join(gone, met, "left_anti"), docs)


def op2_minhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, similarity=CONTRACT).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
