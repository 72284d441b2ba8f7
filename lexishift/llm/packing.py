"""Packing documents into sequences: a configuration linear program over the histogram of lengths.

A document's ids (with the end id) longer than ``capacity`` are cut into pieces of ``capacity``; pieces are packed,
never cut. Only the histogram of piece lengths (at most ``capacity`` rows, whatever the input) goes to the driver.
There the covering program "use as few configurations as cover every length's count" is solved by multiplicative
weights: each round a knapsack dynamic program finds the configuration of most weight, and the lengths that it
covers lose weight. Fractions are rounded down, and what rounding leaves is solved again. Where few pieces are left, or
few were there, each configuration is used once at least, fullest first; the last pieces are placed best-fit decreasing
where that takes no more sequences. The plan is a table (length, ranks from, to -> sequences, offset), so every piece
finds its place by its rank among pieces of its length, by a join.

Ranks come from counts by (length, chunk of ids) and row numbers within a chunk: no length is numbered in one task.

Defined results: a null text is empty (one piece: the end id); repeated rows are packed as often as they occur; a
null ``doc_id`` is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexishift.llm.storage import materialise, workspace
from lexishift.llm.tokens import encoder, vocabulary_path

CAPACITY, END, PLAN_ROWS = 2048, 0, 32
TOKENIZER = "word_bpe_49k.json"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a piece; ``row`` tells rows with one ``doc_id`` apart within an input batch."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = encoder(path, True), np.array([end], "<u4").tobytes()
        for batch in batches:
            cols = [[] for _ in range(6)]
            for at, (doc_id, data) in enumerate(zip(batch.column(0).to_pylist(), enc.encode(batch.column(1)), strict=True)):
                view = memoryview(bytes(data) + tail)
                for k, p in enumerate(range(0, len(view), 4 * capacity)):
                    own = view[p : p + 4 * capacity]
                    for c, v in zip(cols, (doc_id, k, p // 4, len(own) // 4, zlib.crc32(own), at), strict=True):
                        c.append(v)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, PIECES)


def knapsack(weight: np.ndarray, capacity: int, most: np.ndarray) -> np.ndarray:
    """How often each length (index) is taken for the most weight within ``capacity``; ``most`` bounds the copies.

    Unbounded dynamic program over the capacity; a length taken more often than ``most`` allows is cut back.
    """
    lengths = np.flatnonzero(most > 0)
    gain, best, take = weight[lengths], np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        n = np.searchsorted(lengths, c, "right")
        if n:
            value = gain[:n] + best[c - lengths[:n]]
            k = n - 1 - int(value[::-1].argmax())  # of equals the longest: short pieces are kept to fill gaps
            if value[k] > best[c]:
                best[c], take[c] = value[k], lengths[k]
    out, c = np.zeros(len(weight), np.int64), capacity
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            out[take[c]] += 1
            c -= take[c]
    return np.minimum(out, most)


def filled(config: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The configuration with its free room given to the longest lengths that fit and are left."""
    config, room = config.copy(), len(left) - 1 - int(config @ np.arange(len(left)))
    while room > 0:
        fits = np.flatnonzero((left - config)[: room + 1] > 0)
        if not len(fits):
            break
        n = int(min(room // fits[-1], left[fits[-1]] - config[fits[-1]]))
        config[fits[-1]] += n
        room -= n * int(fits[-1])
    return config


def bounded_knapsack(weight: np.ndarray, capacity: int, most: np.ndarray) -> np.ndarray:
    """The same with ``most`` as an exact bound: a length's copies are taken in lots of 1, 2, 4 and so on."""
    lots = []
    for length in np.flatnonzero(most > 0).tolist():
        rest, lot = min(int(most[length]), capacity // length), 1
        while rest:
            lot = min(lot, rest)
            lots.append((length, lot))
            rest, lot = rest - lot, 2 * lot
    best, taken = np.zeros(capacity + 1), np.zeros((len(lots), capacity + 1), bool)
    for k, (length, lot) in enumerate(lots):
        size = length * lot
        with_it = best[: capacity + 1 - size] + lot * weight[length]
        taken[k, size:] = with_it > best[size:]
        best[size:] = np.maximum(best[size:], with_it)
    out, c = np.zeros(len(weight), np.int64), capacity
    for k in range(len(lots) - 1, -1, -1):
        if taken[k, c]:
            out[lots[k][0]] += lots[k][1]
            c -= lots[k][0] * lots[k][1]
    return out


#: Rounds of weights, how fast weights fall, how often what rounding leaves is solved again, and under how many sequences the
#: program has exact bounds and ``FEW_ROUNDS`` rounds.
ROUNDS, RATE, LEVELS, FEW, FEW_ROUNDS = 160, 0.25, 8, 40, 24


def fractions(left: np.ndarray, capacity: int, price, rounds: int) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used by the program's solution for the counts ``left``, fullest first."""
    sizes = np.arange(len(left))
    weight, found = np.where(left > 0, sizes / capacity, 0.0), {}
    for _ in range(rounds):
        config = filled(price(weight, capacity, left), left)
        share = np.divide(config, left, out=np.zeros(len(left)), where=left > 0)
        found[config.tobytes()] = found.get(config.tobytes(), 0.0) + 1 / share.max()
        weight *= np.exp(-RATE * share / share.max())
    scale = int(left @ sizes) / capacity / sum(found.values())  # the rounds' steps, scaled to the volume bound
    return sorted(((np.frombuffer(k, np.int64), scale * n) for k, n in found.items()), key=lambda x: (-int(x[0] @ sizes), -x[1]))


class Cover:
    """Configurations used so far, and the counts that are left to cover."""

    def __init__(self, left: np.ndarray):
        self.left, self.plan = left.copy(), []

    def use(self, config: np.ndarray, times: int) -> None:
        """``times`` sequences of ``config``, or as many as the counts allow."""
        some = config > 0
        times = min(times, int((self.left[some] // config[some]).min()))
        if times > 0:
            self.left -= config * times
            self.plan.append((times, {int(k): int(config[k]) for k in np.flatnonzero(config)}))

    def round_off(self, solution: list[tuple[np.ndarray, float]], least: int) -> None:
        for config, n in solution:
            self.use(config, max(least, int(n)))

    def best_fit(self) -> None:
        """Longest first; each sequence takes the longest piece that fits, and is repeated while counts allow."""
        while self.left.any():
            config = filled(np.zeros_like(self.left), self.left)
            some = config > 0
            self.use(config, max(1, int((self.left[some] // config[some]).min())))

    def sequences(self) -> int:
        return sum(n for n, _ in self.plan)


def solve(histogram: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(how many sequences, {length: copies}) covering ``histogram`` (counts by length, index 0 unused) exactly."""
    cover, sizes = Cover(histogram.astype(np.int64)), np.arange(len(histogram))
    if cover.left[capacity]:
        whole = np.zeros_like(cover.left)
        whole[capacity] = 1
        cover.use(whole, int(cover.left[capacity]))
    for _ in range(LEVELS):
        before = int(cover.left.sum())
        if cover.left @ sizes <= FEW * capacity:
            break
        cover.round_off(fractions(cover.left, capacity, knapsack, ROUNDS), 0)
        if cover.left.sum() > 0.9 * before:
            break
    rest, other = Cover(cover.left), Cover(cover.left)
    other.best_fit()
    if cover.left @ sizes <= FEW * capacity:  # fractions below 1 are taken whole
        while rest.left.any():
            rest.round_off(fractions(rest.left, capacity, bounded_knapsack, FEW_ROUNDS), 1)
            if rest.sequences() >= other.sequences():
                break
    return cover.plan + (other if rest.left.any() else rest).plan


PLAN = "length long, first long, last long, sequence long, per long, offset long"


def placement(plan: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows of PLAN: pieces of ``length`` with rank in [first, last) go ``per`` to a sequence from ``sequence`` on, at ``offset``."""
    rank: dict[int, int] = {}
    rows, base = [], 0
    for times, config in plan:
        offset = 0
        for length, copies in sorted(config.items(), reverse=True):
            first = rank.get(length, 0)
            rank[length] = first + times * copies
            rows.append((length, first, first + times * copies, base, copies, offset))
            offset += length * copies
        base += times
    return rows


def pack(pieces: DataFrame, root: str, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with ``length``) with ``sequence_id`` and ``offset``. ``pieces`` must be a written table.

    The chunk of a piece depends on its row alone, so retried tasks number alike. The plan's size depends on
    ``capacity`` only (it is held to ``PLAN_ROWS * capacity`` rows of six numbers), which is what bounds the broadcast.
    """
    spark = pieces.sparkSession
    chunks = int(max(8, pieces.count() // 200_000 + 1))
    chunked = pieces.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(chunks)))
    counts = materialise(chunked.groupBy("length", "_chunk").agg(F.count("*").alias("n")), f"{root}/counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # at most ``capacity`` rows
        histogram[length] = n
    rows = placement(solve(histogram, capacity))
    if len(rows) > PLAN_ROWS * capacity:
        raise ValueError(f"a plan of {len(rows)} rows is too large to broadcast")
    plan = spark.createDataFrame(rows, PLAN)
    before = counts.withColumn("_before", F.sum("n").over(Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))).select("length", "_chunk", F.coalesce("_before", F.lit(0)).alias("_before"))
    own = Window.partitionBy("length", "_chunk").orderBy("doc_id", "piece", "row", "ids_crc32")
    ranked = chunked.withColumn("_own", F.row_number().over(own) - 1).join(before, ["length", "_chunk"]).withColumn("_rank", F.col("_before") + F.col("_own"))
    placed = ranked.join(F.broadcast(plan), "length").filter("_rank >= first and _rank < last")
    at = F.col("_rank") - F.col("first")
    return placed.select(*pieces.columns, (F.col("sequence") + F.floor(at / F.col("per"))).alias("sequence_id"), (F.col("offset") + at % F.col("per") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of ``docs`` with their places."""
    root = workspace(docs.sparkSession, "packing")
    pieces = materialise(pieces_of(docs, path or vocabulary_path(TOKENIZER), capacity, end), f"{root}/pieces")
    return pack(pieces, root, capacity).drop("row")


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
