"""Spelling variants: words one edit apart, by blocked Gram matrices of their letter counts.

Words are counted where texts are read. Each word has a vector of letter counts; two words one edit apart have vectors at a squared distance
of two at most, and lengths that differ by one at most. Words lie in cells: the counts of ``GROUPS`` groups of letters (of about equal weight in
the vocabulary), whose sum is the length. One insertion adds one to one group, one replacement moves one from a group to another or stays in the cell, so
a cell meets itself and, in one direction of each, its neighbours: the shorter word visits the longer's cell, and of a replacement the
word with more letters of the earlier group visits the other's. Each pair of words that can be near meets exactly once.

A tile is at most about ``HOME`` words of a cell and ``VISITORS`` visitors (fewer where words are long); larger cells are split over several tiles. In a tile, one product
of the blocks of letter counts gives all squared distances; pairs at most two apart have their edit verified letter by letter. A tile returns, of each word
with near words, their number and the most frequent, never the pairs.

A word's form is its most frequent near word if that is at least twice as frequent; roots are found by doubling paths over written tables.

Defined results: a null or empty text has no words; rows with a null ``doc_id`` count with an empty id; repeated rows count again (their ids and texts being equal, so are
their deletions); an empty table gives an empty result; other columns are ignored; words may have any length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexishift.llm.storage import materialise, workspace

DELETE_EVERY, MIN_LENGTH, MIN_COUNT, FORM_TIMES = 97, 5, 3, 2
GROUPS, HOME, VISITORS, LETTERS_A_TILE = 6, 2048, 16384, 1 << 23
KNOWN = 400_000  # words a task holds before it hands their counts on
# The letters, a to z and U+00C0 to U+00FF; what is no letter becomes a blank.
ALPHABET = 26 + 64
_OTHER = re.compile(rb"[\xc2\xc4-\xf4][\x80-\xbf]+")
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def runs(text: bytes) -> list[bytes]:
    """The lower-cased runs of letters of a UTF-8 text."""
    return _OTHER.sub(b" ", text).translate(_KEEP).split()


def mistyped(run: bytes, h: int) -> bytes:
    """``run`` without one code point where the hash says so."""
    if h % DELETE_EVERY:
        return run
    s = run.decode("utf-8")
    at = h % len(s)
    return (s[:at] + s[at + 1 :]).encode("utf-8")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        held = {w: n for w, n in total.items() if len(w) - w.count(b"\xc3") >= MIN_LENGTH}
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
            start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
            for run, n in Counter(runs(text.as_py() or b"")).items():
                h = zlib.crc32(run, start)
                total[run if h % DELETE_EVERY else mistyped(run, h)] += n
            if len(total) > KNOWN:
                yield out()
                total.clear()
    yield out()


def vocabulary(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the distinct words of at least ``MIN_LENGTH`` code points found at least ``min_count`` times."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of each letter of all words in turn, lengths)."""
    cp = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.where(cp < 128, cp - 97, cp - 0xC0 + 26), np.array([len(w) for w in words], np.int64)


def counts_of(number: np.ndarray, lengths: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """Per word how many of its letters ``table`` puts into each of ``width`` columns."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    return np.bincount(row * width + table[number], minlength=len(lengths) * width).reshape(len(lengths), width)


def balanced_groups(weight: dict[int, int], groups: int = GROUPS) -> np.ndarray:
    """A group for each letter: the heaviest first, each to the lightest group. Any choice finds the same words."""
    table, load = np.zeros(ALPHABET, np.int64), [0] * groups
    for letter in sorted(range(ALPHABET), key=lambda c: (-weight.get(c, 0), c)):
        table[letter] = g = load.index(min(load))
        load[g] += weight.get(letter, 0) + 1
    return table


def cell_of(counts: np.ndarray) -> np.ndarray:
    """A number for each row of group counts: the counts themselves if they fit, else a hash."""
    packed = (counts.astype(np.int64) << (10 * np.arange(counts.shape[1]))).sum(1)
    for r in np.flatnonzero((counts > 1023).any(1)):
        packed[r] = -1 - (xxhash.xxh3_64_intdigest(counts[r].astype("<i8").tobytes()) >> 1)
    return packed


#: What a word's cell visits: one more letter in a group, or one moved from an earlier group to a later.
def moves(groups: int) -> np.ndarray:
    one = np.eye(groups, dtype=np.int64)
    return np.array([*one, *(one[h] - one[g] for g in range(groups) for h in range(g + 1, groups))])


def _celled(table: np.ndarray):
    groups = int(table.max()) + 1
    steps = moves(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            number, lengths = letters(batch.column(0).to_pylist())
            counts = counts_of(number, lengths, table, groups)
            distinct, index = np.unique(counts, axis=0, return_inverse=True)  # few cells, many words
            targets = [cell_of(distinct + s) for s in steps]
            there = np.stack([(distinct + s >= 0).all(1) for s in steps], 1)
            lists = [[int(t[r]) for t, ok in zip(targets, there[r], strict=True) if ok] for r in range(len(distinct))]
            index = index.ravel()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lengths), pa.array(cell_of(distinct)[index]), pa.array(lists, pa.list_(pa.int64())).take(pa.array(index))], names=["word", "n", "length", "cell", "targets"]
            )

    return run


FOLD = np.array([*range(26), *(26 + i % 6 for i in range(64))])  # merging letters brings vectors nearer, never apart, so no pair is lost


def one_edit(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Row by row: are two padded words (lengths ``nx`` >= ``ny``) one replaced or one inserted letter apart."""
    same = x == y
    replaced = (nx == ny) & ((~same).sum(1) == 1)
    head = np.logical_and.accumulate(same, 1)
    place = np.arange(x.shape[1])
    head = (head & (place < ny[:, None])).sum(1)
    shifted = np.zeros_like(same)
    shifted[:, :-1] = x[:, 1:] == y[:, :-1]
    shifted |= place >= ny[:, None]  # what lies beyond the shorter word does not stop the suffix
    tail = (np.logical_and.accumulate(shifted[:, ::-1], 1)[:, ::-1] & (place < ny[:, None])).sum(1)
    return replaced | ((nx == ny + 1) & (head + tail >= ny))


class Words:
    """Words of a tile: letters in padded rows, and letter counts with their squared length."""

    def __init__(self, words: list[str], width: int):
        number, self.length = letters(words)
        self.codes = np.zeros((len(words), width), np.uint8)
        self.codes[np.arange(width) < self.length[:, None]] = number + 1
        kind = np.float32 if width < 2000 else np.float64  # exact either way
        self.counts = counts_of(number, self.length, FOLD, 32).astype(kind)
        self.square = (self.counts * self.counts).sum(1, keepdims=True)

    def left(self) -> np.ndarray:
        return np.concatenate([-2 * self.counts, self.square, np.ones_like(self.square)], 1)

    def right(self) -> np.ndarray:
        return np.concatenate([self.counts, np.ones_like(self.square), self.square], 1)


def near(home: Words, other: Words, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of ``home``, row of ``other``) one edit apart: squared distances of two at most, edits verified."""
    rows_i, rows_j, left, right = [], [], home.left(), other.right()
    for s in range(0, len(home.length), 1024):
        part = left[s : s + 1024]
        for t in range(s if same else 0, len(other.length), 4096):
            i, j = np.nonzero(part @ right[t : t + 4096].T <= 2)
            i, j = i + s, j + t
            if same:
                i, j = i[i < j], j[i < j]
            step = max(1, (1 << 22) // home.codes.shape[1])
            for a in range(0, len(i), step):
                p, q = i[a : a + step], j[a : a + step]
                good = one_edit(home.codes[p], other.codes[q], home.length[p], other.length[q])
                rows_i.append(p[good]), rows_j.append(q[good])
    return (np.concatenate(rows_i), np.concatenate(rows_j)) if rows_i else (np.zeros(0, np.int64), np.zeros(0, np.int64))


NEAR = "word string, n_near long, best_n long, best string"


def _tile(table: pa.Table) -> pa.Table:
    words, n, role = table["word"].to_pylist(), table["n"].to_numpy(), table["role"].to_numpy()
    home, other = np.flatnonzero(role == 0), np.flatnonzero(role != 0)
    width = max(map(len, words))
    h = Words([words[r] for r in home], width)
    links = []
    if table["j"][0].as_py() == 0:  # a cell's own pairs are met in one of its tiles
        i, j = near(h, h, True)
        links.append((home[i], home[j]))
    if len(other) and len(home):
        i, j = near(h, Words([words[r] for r in other], width), False)
        links.append((home[i], other[j]))
    u = np.concatenate([x for a, b in links for x in (a, b)] or [np.zeros(0, np.int64)]).astype(np.int64)
    v = np.concatenate([x for a, b in links for x in (b, a)] or [np.zeros(0, np.int64)]).astype(np.int64)
    rank = np.empty(len(words), np.int64)
    rank[np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)] = np.arange(len(words))
    order = np.lexsort((rank[v], -n[v], u))
    u, v = u[order], v[order]
    first = np.flatnonzero(np.diff(u, prepend=-1))
    told = np.diff(np.append(first, len(u)))
    return pa.table([pa.array([words[r] for r in u[first]], pa.string()), pa.array(told, pa.int64()), pa.array(n[v[first]], pa.int64()), pa.array([words[r] for r in v[first]], pa.string())], names=["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, root: str) -> DataFrame:
    """(word, n_near, best_n, best) for those of ``words`` (word, n) that have near words: how many, and the most frequent (ties: the smallest)."""
    spark = words.sparkSession
    letter = F.explode(F.split("word", "")).alias("c")
    weight = {(ord(r["c"]) - 97 if r["c"] < "\x80" else ord(r["c"]) - 0xC0 + 26): r["count"] for r in words.select(letter).filter("c <> ''").groupBy("c").count().collect()}  # one row a letter, 90 at most
    celled = materialise(words.mapInArrow(_celled(balanced_groups(weight)), "word string, n long, length long, cell long, targets array<long>"), f"{root}/celled")
    cells = celled.groupBy("cell").agg(F.count("*").alias("size"), F.max("length").alias("length"), F.first("targets").alias("targets"))
    fit = lambda most: F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.lit(LETTERS_A_TILE) / F.col("length"))))
    cells = materialise(cells.withColumn("k", F.ceil(F.col("size") / fit(HOME))), f"{root}/cells")
    visits = cells.select(F.col("cell").alias("source"), F.col("size").alias("many"), F.explode("targets").alias("cell"))
    met = visits.join(cells.select("cell", "k", "length"), "cell")
    load = met.groupBy("cell").agg(F.sum("many").alias("many"))
    tiles = cells.join(load, "cell", "left").select("cell", "k", F.greatest(F.lit(1), F.ceil((F.coalesce("many", F.lit(0)) + F.when(F.col("k") > 1, F.col("size")).otherwise(0)) / fit(VISITORS))).alias("m"))
    tiles = materialise(tiles, f"{root}/tiles")
    plan = met.select("source", "cell").join(tiles, "cell").groupBy("source").agg(F.collect_list(F.struct("cell", "k", "m")).alias("visits"))  # as many as there are moves, at most
    plan = tiles.join(plan.withColumnRenamed("source", "cell"), "cell", "left")
    mark = F.xxhash64("word")
    own, place = F.pmod(mark, F.col("k")), lambda m: F.pmod(F.shiftrightunsigned(mark, 20), m)
    until = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
    row = lambda cell, i, j, role: F.struct(cell.alias("cell"), i.cast("long").alias("i"), j.cast("long").alias("j"), F.lit(role).alias("role"))
    at_home = F.transform(until(F.col("m")), lambda j: row(F.col("cell"), own, j, 0))
    among_peers = F.transform(until(own), lambda i: row(F.col("cell"), i, place(F.col("m")), 1))
    away = F.flatten(F.transform(F.coalesce("visits", F.array().cast("array<struct<cell:bigint,k:bigint,m:bigint>>")), lambda v: F.transform(until(v["k"]), lambda i: row(v["cell"], i, place(v["m"]), 1))))
    rows = celled.select("word", "n", "cell").join(plan, "cell").select("word", "n", F.explode(F.concat(at_home, among_peers, away)).alias("t")).select("t.*", "word", "n")
    found = rows.groupBy("cell", "i", "j").applyInArrow(_tile, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("neg"), "best")).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.neg")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame, root: str) -> DataFrame:
    """(word, root) for all words of ``forms`` (word, form): where their forms lead to. Paths double each round; a form is more frequent than its word, so there are no circles."""
    held, turn = materialise(forms.select("word", F.col("form").alias("root")), f"{root}/roots-0"), 0
    while True:
        onward = held.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        turn += 1
        longer = materialise(held.join(onward, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), f"{root}/roots-{turn}")
        held = longer.select("word", "root")
        if longer.filter("moved").isEmpty():
            return held


def variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_count: int = MIN_COUNT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``docs``."""
    folder = workspace(docs.sparkSession, "variants")
    words = materialise(vocabulary(docs, text, doc_id, min_count), f"{folder}/words")
    close = materialise(near_words(words, folder), f"{folder}/near")
    told = words.join(close, "word", "left")
    form = F.when(F.col("best_n") >= FORM_TIMES * F.col("n"), F.col("best"))
    told = materialise(told.select("word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form.isNotNull(), F.col("best_n")).alias("form_n")), f"{folder}/forms")
    last = roots(told.filter("form is not null"), folder)
    return told.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
