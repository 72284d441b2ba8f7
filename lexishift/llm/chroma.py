"""Chroma audio fingerprints: recordings become packed integers, and integers in common align recordings.

A recording's spectrum is folded to twelve pitch classes a frame. Filters compare sums over rectangles of that image
(read from one integral image); each filter's value becomes two bits, sixteen filters one 32-bit integer a frame. Two
recordings match if they differ in a share of ``MAX_ERROR`` of their bits at most at some offset that lays ``MIN_OVERLAP``
frames over each other. (Unrelated recordings of the given tables differ in 0.28 at least where 48 frames overlap, but
come down to 0.24 in 24 frames, which therefore are not enough.)

Offsets are proposed by parts of the integers: a key is ``KEY_BITS`` bits taken from the integers of ``WINDOW`` frames, and
``TABLES`` keys, each of its own places, are made of every window of a query and of every ``STEP``-th of all others. Equal keys
vote for an offset; the histogram of offsets is checked bit by bit at every offset that has a vote. Bits differ in how often
noise turns them and in how much they tell recordings apart, so keys take the ``BITS`` best, which are fitted on
``FIT_SAMPLE`` recordings that are played again with noise. Every recording is indexed; only the choice of bits is fitted.

Recordings with equal fingerprints are one class; searches join query keys with class keys, so copies cost one
row each. A key that also stood ``RUN`` frames before is left out: deep in a sound that goes on unchanged, windows tell no
offset, while its beginning and end do. No number of partners or candidates is capped.

The given tables hold no audio, so the query's recordings are derived from ``embeddings``: each vector is played as a row of tones
(one a component, its size choosing the pitch class), as 8-bit PCM in a WAV column.

Defined results: null, damaged, silent and too short recordings have an empty fingerprint and match nothing; recordings
of fewer than ``MIN_OVERLAP`` frames match their own class only; rows with a null id are left out; repeated rows are
members of one class; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexishift.llm.storage import materialise, workspace

RATE, FRAME, HOP, BANDS = 4000, 512, 128, 12
NOTE = 256  # samples a component of a derived recording
QUERY_EVERY, MAX_ERROR, MIN_OVERLAP = 100, 0.25, 64
WINDOW, STEP, RUN, TABLES, KEY_BITS, BITS, FIT_SAMPLE, FIT_NOISE = 32, 8, 32, 12, 28, 8, 64, 0.8  # the noise in parts of the sound's own deviation
# Integers of the fingerprints of a part of the queries and of all others, least number of parts of the latter, and integers compared at once.
HELD, CELLS, TOGETHER = (1 << 20, 1 << 22), 64, 1 << 20
# Fixed values: (kind, first band, bands, frames) of the sixteen filters; kinds compare halves as _responses says.
FILTERS = [(0, 0, 4, 8), (0, 4, 4, 8), (0, 8, 4, 8), (0, 0, 12, 8), (1, 0, 4, 8), (1, 4, 4, 8), (1, 8, 4, 8), (1, 2, 8, 8), (2, 0, 6, 8), (2, 6, 6, 8), (2, 3, 6, 4), (3, 0, 12, 9), (3, 0, 6, 9), (3, 6, 6, 9), (4, 0, 12, 8), (4, 3, 9, 8)]
WIDEST = max(f[3] for f in FILTERS)
CUTS = (-0.18, 0.0, 0.18)


def play(vector) -> bytes:
    """A vector as a WAV file: one tone a component."""
    x = np.asarray(vector, np.float64)
    spread = np.abs(x).max() or 1.0
    pitch = np.clip(((x / spread + 1) * 6).astype(int), 0, BANDS - 1)
    t = np.arange(NOTE) / RATE
    tones = np.sin(2 * np.pi * 440.0 * 2.0 ** (pitch[:, None] / BANDS) * t[None])
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(1), w.setframerate(RATE)
        w.writeframes((tones.ravel() * 100 + 128).astype(np.uint8).tobytes())
    return out.getvalue()


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Frames by pitch classes, each frame of unit length; silent frames are zero."""
    if len(samples) < FRAME:
        return np.zeros((0, BANDS))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP] * np.hanning(FRAME)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    hertz = np.fft.rfftfreq(FRAME, 1 / rate)
    use = (hertz >= 100) & (hertz <= 1900)
    band = np.round(BANDS * np.log2(hertz[use] / 440.0)).astype(int) % BANDS
    image = power[:, use] @ np.eye(BANDS)[band]
    norm = np.linalg.norm(image, axis=1, keepdims=True)
    return np.where(norm > 1e-3, image / np.maximum(norm, 1e-3), 0.0)


def _responses(image: np.ndarray) -> np.ndarray:
    """Filter values at each place where the widest filter fits."""
    total = np.zeros((image.shape[0] + 1, BANDS + 1))
    total[1:, 1:] = image.cumsum(0).cumsum(1)
    n = image.shape[0] - WIDEST + 1
    at = np.arange(n)
    area = lambda t0, t1, b0, b1: total[at + t1, b1] - total[at + t0, b1] - total[at + t1, b0] + total[at + t0, b0]
    out = np.empty((n, len(FILTERS)))
    for k, (kind, b, h, w) in enumerate(FILTERS):
        whole, t, m = area(0, w, b, b + h), w // 2, b + h // 2
        if kind == 0:  # later half against earlier half
            part = area(t, w, b, b + h)
        elif kind == 1:  # upper half against lower half
            part = area(0, w, m, b + h)
        elif kind == 2:  # opposite quarters
            part = area(0, t, b, m) + area(t, w, m, b + h)
        elif kind == 3:  # middle third of time
            part = 1.5 * area(w // 3, 2 * w // 3, b, b + h)
        else:  # middle third of bands
            part = 1.5 * area(0, w, b + h // 3, b + 2 * h // 3)
        out[:, k] = np.log((1 + part) / (1 + np.maximum(whole - part, 0.0)))
    return out


def sound(recording: bytes | None) -> tuple[np.ndarray, int]:
    """(samples from -1 to 1, rate) of a WAV file; no samples where it can't be read."""
    try:
        with wave.open(io.BytesIO(recording or b"")) as w:
            width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
            raw = w.readframes(w.getnframes())
    except (wave.Error, EOFError):
        return np.zeros(0), RATE
    if width not in (1, 2):
        return np.zeros(0), RATE
    x = np.frombuffer(raw[: len(raw) // width * width], "u1" if width == 1 else "<i2").astype(np.float64)
    x = (x - 128) / 128 if width == 1 else x / 32768
    return x[: len(x) // channels * channels].reshape(-1, channels).mean(1), rate


def fingerprint(samples: np.ndarray, rate: int) -> np.ndarray:
    """Packed integers of a sound, two bits a filter (Gray code, so near values differ in one bit)."""
    image = chroma(samples, rate)
    if len(image) < WIDEST or not image.any():
        return np.zeros(0, np.uint32)
    level = np.searchsorted(CUTS, _responses(image))
    return ((level ^ (level >> 1)) << (2 * np.arange(len(FILTERS)))[None]).sum(1).astype(np.uint32)


def recordings(embeddings: DataFrame) -> DataFrame:
    """(rec_id, audio) derived from (vec_id, embedding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                audio = [play([0.0 if v is None else v for v in x]) if x else None for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(audio, pa.binary())], names=["rec_id", "audio"])

    return embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "rec_id long, audio binary")


def fingerprints(media: DataFrame) -> DataFrame:
    """(rec_id, print_a, print_b, print): the packed integers, and a 128-bit name of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(*sound(x.as_py())) for x in batch.column(1)]
            names = [np.frombuffer(xxhash.xxh3_128_digest(p.tobytes()), np.int64) for p in prints]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([int(x[0]) for x in names], pa.int64()), pa.array([int(x[1]) for x in names], pa.int64()), pa.array([p.view(np.int32) for p in prints], pa.list_(pa.int32()))],
                names=["rec_id", "print_a", "print_b", "print"],
            )

    return media.mapInArrow(run, "rec_id long, print_a long, print_b long, print array<int>")


def best_bits(sample: list[bytes], count: int = BITS) -> np.ndarray:
    """The bits that noise turns least for what they tell apart, by the recordings of ``sample``.

    A bit is the better the less likely noise is to turn it, measured in the likelihood that two recordings agree in it.
    """
    rng, turned, share = np.random.default_rng(14), [], []
    spread = lambda p: p[:, None] >> np.arange(32, dtype=np.uint32) & 1
    for recording in sample:
        x, rate = sound(recording)
        bits = spread(fingerprint(x, rate))
        if len(bits):
            turned.append((bits != spread(fingerprint(x + rng.normal(0, FIT_NOISE * x.std(), len(x)), rate))[: len(bits)]).mean(0))
            share.append(bits.mean(0))
    if not turned:
        return np.arange(1, 32, 2)[:count]  # of each filter the sign
    set_ = np.mean(share, 0)
    flips, differ = np.clip(np.mean(turned, 0), 1e-3, 0.999), np.clip(2 * set_ * (1 - set_), 1e-3, 0.999)
    return np.sort(np.argsort(np.log1p(-flips) / np.log1p(-differ), kind="stable")[:count])


def window_keys(prints: np.ndarray, bits: np.ndarray, step: int) -> np.ndarray:
    """Keys (recording, table, window) of fingerprints of one length: a table's bits of every ``step``-th window."""
    rng = np.random.default_rng(15)
    width = prints.shape[1] - WINDOW + 1
    out = np.empty((len(prints), TABLES, len(range(0, width, step))), np.uint64)
    for k in range(TABLES):
        key = np.full(out.shape[::2], k, np.uint64)
        for frame, bit in zip(rng.integers(0, WINDOW, KEY_BITS), rng.choice(bits, KEY_BITS), strict=True):
            key = key << np.uint64(1) | (prints[:, frame : frame + width : step] >> np.uint32(bit) & np.uint32(1))
        out[:, k] = key
    return out


def keyed(classes: DataFrame, bits: np.ndarray, step: int, name: str, at: str) -> DataFrame:
    """(key, ``name``, ``at``) of all windows that begin at a multiple of ``step``; a key that stood ``RUN`` frames before is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, prints = batch.column(0).to_numpy(), batch.column(1)
            sizes = np.diff(prints.offsets.to_numpy())
            for size in np.unique(sizes[sizes >= MIN_OVERLAP]):
                rows = np.flatnonzero(sizes == size)
                for a in range(0, len(rows), 1024):
                    part = rows[a : a + 1024]
                    flat = prints.take(pa.array(part)).flatten().to_numpy().view(np.uint32).reshape(len(part), size)
                    keys = window_keys(flat, bits, step)
                    held, fresh = RUN // step, np.ones(keys.shape, bool)
                    fresh[:, :, held:] = keys[:, :, held:] != keys[:, :, :-held]
                    i, _, w = np.nonzero(fresh)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[fresh].view(np.int64)), pa.array(reps[part][i]), pa.array((w * step).astype(np.int32))], names=["key", name, at])

    return classes.select("rep", "print").mapInArrow(run, f"key long, {name} long, {at} int")


def compared(votes: DataFrame, asked: DataFrame, classes: DataFrame, max_error: float, min_overlap: int) -> DataFrame:
    """(a, b, shift, votes, bit_error) of those ``votes`` (a, b, shift, votes) at which recording a of ``asked`` matches b of ``classes``.

    Chance votes grow with the product of both, so no vote carries a fingerprint: both sides are cut by hashes of their ids into parts of about ``HELD`` integers,
    the cell of two parts gets both parts' fingerprints first and then its votes, which a task compares as they come.
    """
    parts = lambda df, held, least: max(least, (df.agg(F.sum(F.size("print").cast("long"))).first()[0] or 0) // held)
    n, m = parts(asked, HELD[0], 1), parts(classes, HELD[1], CELLS)
    part = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k))
    none, no_print = F.lit(None), F.lit(None).cast("array<int>")
    row = lambda df, cell, kind, a, b, shift, count, x: df.select(cell.cast("long").alias("cell"), F.lit(kind).alias("kind"), a.cast("long").alias("a"), b.cast("long").alias("b"), shift.cast("int").alias("shift"), count.cast("long").alias("votes"), x.alias("print"))
    xs = asked.select("rep", "print", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("other"))
    ys = classes.select("rep", "print", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other"))
    rows = row(xs, part("rep", n) * m + F.col("other"), 0, F.col("rep"), none, none, none, F.col("print"))
    rows = rows.unionByName(row(ys, F.col("other") * m + part("rep", m), 1, none, F.col("rep"), none, none, F.col("print")))
    rows = rows.unionByName(row(votes, part("a", n) * m + part("b", m), 2, F.col("a"), F.col("b"), F.col("shift"), F.col("votes"), no_print))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides, held = None, ([], []), None
        for batch in batches:
            cell, kind = batch.column("cell").to_numpy(), batch.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(cell) != 0) | (np.diff(kind) != 0)) + 1), batch.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                if now != cell[lo]:
                    now, sides, held = cell[lo], ([], []), None
                piece = batch.slice(lo, hi - lo)
                if kind[lo] < 2:
                    sides[kind[lo]].append((piece.column("ab"[kind[lo]]).to_numpy(), piece.column("print")))
                    continue
                if held is None:
                    held, sides = [_Prints(x) for x in sides], ([], [])
                yield from _matching(piece, *held, max_error, min_overlap)

    return rows.repartition("cell").sortWithinPartitions("cell", "kind").mapInArrow(run, "a long, b long, shift int, votes long, bit_error double")


class _Prints:
    """Fingerprints by id: ``flat`` holds one after another, each from its place in ``start``."""

    def __init__(self, parts: list[tuple[np.ndarray, pa.Array]]):
        ids = np.concatenate([i for i, _ in parts])
        size = np.concatenate([np.diff(x.offsets.to_numpy()) for _, x in parts])
        self.flat = np.concatenate([x.flatten().to_numpy() for _, x in parts]).view(np.uint32)
        order = np.argsort(ids)
        self.ids, self.start, self.size = ids[order], (np.cumsum(size, dtype=np.int64) - size)[order], size[order]

    def at(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = np.searchsorted(self.ids, ids)
        return self.start[found], self.size[found]


def _matching(part: pa.RecordBatch, x: _Prints, y: _Prints, max_error: float, min_overlap: int) -> Iterator[pa.RecordBatch]:
    """Those votes of ``part`` at whose offset enough frames lie over each other and differ in few enough bits."""
    (x0, nx), (y0, ny), shift = x.at(part.column("a").to_numpy()), y.at(part.column("b").to_numpy()), part.column("shift").to_numpy().astype(np.int64)
    low = np.maximum(0, -shift)
    overlap = np.minimum(nx, ny - shift) - low
    asked = np.flatnonzero(overlap >= max(1, min_overlap))
    ends, at = np.cumsum(overlap[asked]), 0
    while at < len(asked):
        until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, "right")))
        rows, at = asked[at:until], until
        n = overlap[rows]
        first = np.cumsum(n) - n
        step = np.arange(n.sum()) - np.repeat(first, n)
        turned = np.bitwise_count(x.flat[np.repeat(x0[rows] + low[rows], n) + step] ^ y.flat[np.repeat(y0[rows] + low[rows] + shift[rows], n) + step])
        error = np.add.reduceat(turned, first, dtype=np.int64) / (32.0 * n)
        good = error <= max_error
        if good.any():
            kept = part.select(["a", "b", "shift", "votes"]).take(pa.array(rows[good]))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(error[good])], names=["a", "b", "shift", "votes", "bit_error"])


def align(media: DataFrame, query_every: int = QUERY_EVERY, max_error: float = MAX_ERROR, min_overlap: int = MIN_OVERLAP, sample: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(membership, matches). Membership: (rec_id, class_id) for every recording, without a class where its fingerprint is empty.
    Matches: (query_id, class_id, match_id, match_members, shift, votes, bit_error) for each query row and matching class.

    ``class_id`` and ``match_id`` are the smallest ids of their classes; a query matches its own class with shift 0. Of several
    offsets that match, that with the least ``bit_error`` is told. Bits are fitted on the first ``FIT_SAMPLE`` rows of ``sample`` (rec_id, audio), which is all of ``media`` where none is given, in the
    order of their ids, so every run and partitioning takes the same.
    """
    root = workspace(media.sparkSession, "chroma")
    media = media.select("rec_id", "audio").filter("rec_id is not null")
    first = (media if sample is None else sample).filter("rec_id is not null and audio is not null").orderBy("rec_id", F.xxhash64("audio")).limit(FIT_SAMPLE)
    bits = best_bits([r.audio for r in first.collect()])  # FIT_SAMPLE recordings
    table = materialise(fingerprints(media), f"{root}/prints")
    classes = table.filter(F.size("print") > 0).groupBy("print_a", "print_b").agg(F.min("rec_id").alias("rep"), F.count("*").alias("members"), F.first("print").alias("print"))
    classes = materialise(classes, f"{root}/classes")
    queries = table.filter(f"rec_id % {query_every} = 0").select("rec_id", "print_a", "print_b").join(classes.select("print_a", "print_b", "rep"), ["print_a", "print_b"]).select(F.col("rec_id").alias("query_id"), "rep")
    queries = materialise(queries, f"{root}/queries")
    asked = materialise(classes.join(queries.select("rep").distinct(), "rep", "left_semi"), f"{root}/asked")
    # sizes of files tell nothing about what keys they hold (less than 400 bytes of a recording make 87 KB of a hash table), so Spark must not choose a broadcast by them
    met = keyed(asked, bits, 1, "a", "i").hint("merge").join(keyed(classes, bits, STEP, "b", "j"), "key").filter("a <> b")
    votes = materialise(met.groupBy("a", "b", (F.col("j") - F.col("i")).alias("shift")).agg(F.count("*").alias("votes")), f"{root}/votes")
    scored = compared(votes, asked, classes, max_error, min_overlap)
    best = scored.groupBy("a", "b").agg(F.min(F.struct("bit_error", F.abs("shift").alias("far"), "shift", "votes")).alias("top"))
    best = best.select("a", "b", "top.shift", "top.votes", "top.bit_error")
    same = asked.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(0).alias("shift"), F.size("print").cast("long").alias("votes"), F.lit(0.0).alias("bit_error"))
    found = best.unionByName(same).hint("merge").join(classes.select(F.col("rep").alias("b"), "members"), "b")
    matches = queries.join(found, queries.rep == found.a).select("query_id", F.col("a").alias("class_id"), F.col("b").alias("match_id"), F.col("members").alias("match_members"), "shift", "votes", "bit_error")
    members = table.select("rec_id", "print_a", "print_b").join(classes.select("print_a", "print_b", F.col("rep").alias("class_id")), ["print_a", "print_b"], "left").select("rec_id", "class_id")
    return members, matches


def op9_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each recording: its class, how many queries (every row whose id 100 divides) match it, and of these the one that
    fits best, with their alignment; null where none does. The pairs themselves are what :func:`align` returns."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    first = table.filter("vec_id is not null and size(embedding) > 0").orderBy("vec_id", F.xxhash64("embedding")).limit(FIT_SAMPLE)
    members, matches = align(recordings(table), sample=recordings(first))
    best = F.min(F.struct("bit_error", "query_id", "shift", "votes")).alias("top")
    per = matches.groupBy(F.col("match_id").alias("class_id")).agg(F.count("*").alias("n_queries"), best)
    told = members.join(per, "class_id", "left")
    return told.select("rec_id", "class_id", F.coalesce("n_queries", F.lit(0)).alias("n_queries"), "top.query_id", "top.shift", "top.votes", "top.bit_error")
