"""Phrase collocations by dynamic itemset counting: lengths are counted interleaved, in cyclic scans of shards.

Texts are dealt into ``SHARDS`` shards. Step t scans shard t mod ``SHARDS``. Words are counted from step 0 on; a longer phrase is active from the
first step at whose start both its subphrases (without its last, without its first word) have reached the threshold, and is
counted for one full cycle. The scans end when a whole cycle has activated nothing new. So phrases of several lengths are counted in one scan,
and a phrase that is not frequent never makes its longer ones be counted.

What has reached the threshold is kept as a filter of bits (one a hashed phrase, of a size fixed after the first scan and bounded by
``MOST_BITS``), written to the shared folder each step. Bits are only ever set, so a phrase that passes the filter at a step passes it at all later ones:
it is counted at step t if it passes the filter of step t and not that of ``SHARDS`` steps before, which is once a shard, without
state in the tasks. A bit set by another phrase lets a phrase be counted in vain; none is missed, and a full filter costs time, not results.
Counts of phrases in the middle of their cycle are one table, summed by hash; those that reach the threshold or end their cycle leave it.

A last scan counts what has passed the filter by 128 bits, and takes down its text where a task first meets it, so results do not rest on the 64 bits
that the filter and the tables of sums go by. Words of up to 16 bytes have 128 bits each of their own, longer ones those of a BLAKE2b digest, so no words that are made
to share a name do. Scores are exact: products are taken as decimals.

Defined results: a null or empty text has no words; a null ``lang`` is ``und``; repeated rows count again; ties in score go to the more frequent
phrase, then to the smaller in byte order; an empty table gives an empty result; other columns are ignored; words may have any length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexishift.llm.storage import delete, materialise, task_fs, workspace

SHARDS, LONGEST, LEAST, TOP, COVERED = 3, 4, 30, 2000, 80
FEW_BITS, MOST_BITS, BITS_A_KEY, CHUNK = 20, 30, 8, 18  # sizes of the filter, as powers of two but for the third
GROUP_BYTES, KNOWN = 1 << 20, 1 << 20
_BLANKS, _BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)
_KIND[list(_BLANKS)], _KIND[list(_BREAKS)] = 1, 2
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_FILL = np.array([(1 << 64) - (1 << 8 * n) for n in range(9)], np.uint64)  # what a word of n bytes leaves of eight


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def digest(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(blake2b(data, digest_size=size).digest(), "<u8")


class Tokens:
    """The words of some texts of one language: hashes, places in the lower-cased bytes, and the number of the piece each stands in."""

    def __init__(self, texts: list[bytes], lang: bytes):
        self.bytes = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n" * 16, np.uint8)]  # every word has 16 bytes from its start
        kind = _KIND[self.bytes]
        edge = np.flatnonzero(np.diff(kind == 0, prepend=False, append=False))
        self.start, self.end = edge[::2], edge[1::2]
        self.piece = np.cumsum(kind == 2)[self.start]
        low, self.high = self._keys()
        self.word = mixed(low ^ mixed(self.high + digest(lang, 8)))

    @cached_property
    def check(self) -> np.ndarray:
        """A second name of each word; both names together tell its key, so words with different keys differ in one of them."""
        return mixed(self.high ^ mixed(self.word + np.uint64(0x9E3779B97F4A7C15)))

    def _keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Two halves of each word's key: its own bytes up to 16 of them, filled up with a byte that no text holds; a digest of a longer word."""
        eight = np.ndarray(len(self.bytes) - 7, "<u8", self.bytes, 0, (1,))
        size = self.end - self.start
        low, high = (eight[self.start + at] | _FILL[np.clip(size - at, 0, 8)] for at in (0, 8))
        for k in np.flatnonzero(size > 16):
            low[k], high[k] = digest(self.bytes[self.start[k] : self.end[k]], 16)
        return low, high

    def longer(self, hashes: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
        """Names of the phrases of ``length`` words that begin at each place, from those of one word less and the words' own."""
        return mixed(hashes[:-1] * np.uint64(2 * length + 1) + mixed(words[length - 1 :] ^ np.uint64(length)))

    def whole(self, length: int) -> np.ndarray:
        """Does the phrase of ``length`` words at a place lie within one piece."""
        return self.piece[length - 1 :] == self.piece[: len(self.piece) - length + 1]

    def text(self, at: int, length: int) -> bytes:
        return b" ".join(self.bytes[self.start[k] : self.end[k]].tobytes() for k in range(at, at + length))


_BREAK = re.compile(b"[" + re.escape(_BREAKS) + b"]")


def parts(text: bytes) -> Iterator[bytes]:
    """A text in parts of about ``GROUP_BYTES``, cut where a piece ends; a longer piece stays whole."""
    at = 0
    while len(text) - at > GROUP_BYTES and (end := _BREAK.search(text, at + GROUP_BYTES)):
        yield text[at : end.end()]
        at = end.end()
    yield text[at:]


def languages(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """(language, texts) in groups of about ``GROUP_BYTES``."""
    held: dict[str, tuple[list[bytes], int]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
        for raw in parts(text.as_py() or b""):
            texts, size = held.pop(lang, ([], 0))
            texts.append(raw)
            if size + len(raw) >= GROUP_BYTES:
                yield lang, texts
            else:
                held[lang] = texts, size + len(raw)
    for lang, (texts, _) in held.items():
        yield lang, texts


class Filter:
    """The bits of a step, as read from its table; empty where the step has none."""

    def __init__(self, uri: str | None, bits: int):
        self.shift, self.data = np.uint64(64 - bits), None
        if uri:
            import pyarrow.dataset as ds

            fs, base = task_fs(uri)
            data = np.zeros(1 << max(0, bits - 3), np.uint8)
            width = 1 << (min(bits, CHUNK) - 3)
            for batch in ds.dataset(base, filesystem=fs, format="parquet").to_batches(columns=["chunk", "data"]):
                for chunk, held in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    data[chunk * width : (chunk + 1) * width] = np.frombuffer(held.as_buffer(), np.uint8)
            self.data = data

    def has(self, names: np.ndarray) -> np.ndarray:
        if self.data is None:
            return np.zeros(len(names), bool)
        slot = names >> self.shift
        return (self.data[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def active(tokens: Tokens, now: Filter, before: Filter, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, names) of the phrases to count: both subphrases pass ``now``, and not both passed ``before``."""
    names = tokens.word
    for length in range(2, longest + 1):
        if len(names) < 2:
            return
        pass_now, pass_before = now.has(names), before.has(names)
        both = pass_now[:-1] & pass_now[1:] & tokens.whole(length)
        if not both.any():
            return
        names = tokens.longer(names, tokens.word, length)
        fresh = np.flatnonzero(both & ~(pass_before[:-1] & pass_before[1:]))
        yield length, fresh, names[fresh]


class Sums:
    """Counts by name, summed in pieces, handed on when they are many."""

    def __init__(self):
        self.names, self.counts, self.size = [], [], 0

    def add(self, names: np.ndarray) -> None:
        if len(names):
            u, n = np.unique(names, return_counts=True)
            self.names.append(u), self.counts.append(n)
            self.size += len(u)

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.names:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        names, counts = np.concatenate(self.names), np.concatenate(self.counts)
        order = np.argsort(names)
        names, counts = names[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        self.names, self.counts, self.size = [names[first]], [np.add.reduceat(counts, first)], len(first)
        return self.names[0], self.counts[0]


def _scan(now_uri: str | None, before_uri: str | None, bits: int, words: bool, longest: int):
    """(name, n) of what a step counts in the texts of its shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before, sums, floor = Filter(now_uri, bits), Filter(before_uri, bits), Sums(), 0

        def out() -> pa.RecordBatch:
            names, counts = sums.fold()
            return pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(counts.astype(np.int64))], names=["name", "n"])

        for batch in batches:
            for lang, texts in languages(batch):
                tokens = Tokens(texts, lang.encode("utf-8"))
                if words:
                    sums.add(tokens.word)
                for _, _, names in active(tokens, now, before, longest):
                    sums.add(names)
                if sums.size > floor + KNOWN:  # pieces are summed; what stays many goes on
                    sums.fold()
                    floor = sums.size
                    if floor > 2 * KNOWN:
                        yield out()
                        sums, floor = Sums(), 0
        yield out()

    return run


class Named:
    """Counts by both hashes of a phrase, and its text where a task first meets it."""

    def __init__(self):
        self.parts, self.size, self.seen, self.late = [], 0, np.zeros(0, np.uint64), []
        self.told: list[tuple[np.ndarray, pa.Array]] = []

    def add(self, tokens: Tokens, length: int, places: np.ndarray, names: np.ndarray, checks: np.ndarray) -> None:
        if not len(names):
            return
        order = np.argsort(names)
        held, told = names[order], checks[order]
        same = held[1:] == held[:-1]
        if (same & (told[1:] != told[:-1])).any():  # two phrases share a name
            order = np.lexsort((checks, names))
            held, told = names[order], checks[order]
            same = (held[1:] == held[:-1]) & (told[1:] == told[:-1])
        edge = np.flatnonzero(np.concatenate([[True], ~same]))
        first, n = order[edge], np.diff(np.append(edge, len(order)))
        self.parts.append(np.stack([names[first], checks[first], n.astype(np.uint64)]))
        self.size += len(first)
        ids = self.ids(names[first], checks[first])
        at = np.minimum(np.searchsorted(self.seen, ids), max(0, len(self.seen) - 1))
        fresh = self.seen[at] != ids if len(self.seen) else np.ones(len(ids), bool)
        if fresh.any():
            self.told.append((ids[fresh], pa.array([tokens.text(int(places[k]), length) for k in first[fresh]], pa.binary())))
            self.late.append(ids[fresh])
        if sum(map(len, self.late)) > KNOWN // 16:  # those that are not sorted in yet may be told again
            self.seen, self.late = np.unique(np.concatenate([self.seen, *self.late])), []

    @staticmethod
    def ids(names: np.ndarray, checks: np.ndarray) -> np.ndarray:
        return mixed(names ^ checks * np.uint64(0x2545F4914F6CDD1D))

    def fold(self) -> None:
        names, checks, n = np.concatenate(self.parts, 1) if self.parts else np.zeros((3, 0), np.uint64)
        order = np.lexsort((checks, names))
        names, checks, n = names[order], checks[order], n[order]
        edge = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]) | (checks[1:] != checks[:-1])])) if len(names) else np.zeros(0, np.int64)
        self.parts = [np.stack([names[edge], checks[edge], np.add.reduceat(n, edge)])] if len(edge) else []
        self.size = len(edge)

    def batch(self, lang: str, length: int) -> pa.RecordBatch:
        """What has been counted, folded; counting begins anew, and texts told are not told again."""
        self.fold()
        names, checks, n = self.parts[0] if self.parts else np.zeros((3, 0), np.uint64)
        texts = pa.nulls(len(names), pa.binary())
        if self.told:
            ids, own = self.ids(names, checks), np.concatenate([x for x, _ in self.told])
            order = np.argsort(own)
            at = np.minimum(np.searchsorted(own, ids, sorter=order), len(own) - 1)
            texts = pa.concat_arrays([x for _, x in self.told]).take(pa.array(order[at], mask=own[order[at]] != ids))
        self.parts, self.size, self.told = [], 0, []
        self.seen, self.late = np.unique(np.concatenate([self.seen, *self.late])) if len(self.seen) < 2 * KNOWN else np.zeros(0, np.uint64), []
        return _rows(lang, length, names, checks, texts, n)


def _rows(lang: str, length: int, names, checks, texts, n) -> pa.RecordBatch:
    size = len(names)
    columns = [pa.array([lang] * size, pa.string()), pa.array(np.full(size, length, np.int32)), pa.array(names.view(np.int64)), pa.array(checks.view(np.int64)), texts.cast(pa.string()), pa.array(n.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "length", "name", "check", "phrase", "n"])


NAMED = "lang string, length int, name long, check long, phrase string, n long"


def _named(uri: str | None, bits: int, longest: int):
    """(lang, length, name, check, phrase, n) of the words and phrases that pass the filter, the text where a task first meets one; under length 0 how many words there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nothing = Filter(uri, bits), Filter(None, bits)
        held: dict[tuple[str, int], Named] = {}
        words: dict[str, int] = {}
        size, floor = lambda: sum(x.size for x in held.values()), 0
        for batch in batches:
            for lang, texts in languages(batch):
                tokens = Tokens(texts, lang.encode("utf-8"))
                words[lang] = words.get(lang, 0) + len(tokens.word)
                own, checks, reached = np.flatnonzero(now.has(tokens.word)), tokens.check, 1
                for length, places, names in [(1, own, tokens.word[own]), *active(tokens, now, nothing, longest)]:
                    while reached < length:
                        reached += 1
                        checks = tokens.longer(checks, tokens.check, reached)
                    good = now.has(names)
                    held.setdefault((lang, length), Named()).add(tokens, length, places[good], names[good], checks[places[good]])
                if size() > floor + KNOWN // 4:
                    for x in held.values():
                        x.fold()
                    floor = size()
                    if floor > KNOWN:
                        for (a, k), x in held.items():
                            yield x.batch(a, k)
                        floor = 0
        for (lang, length), x in held.items():
            yield x.batch(lang, length)
        for lang, n in words.items():
            zero = np.zeros(1, np.uint64)
            yield _rows(lang, 0, zero, zero, pa.array([b""]), np.array([n]))

    return run


def _bits_of(bits: int):
    """A chunk of the filter with the bits of new names (slot) set, over its earlier bytes."""
    width = min(bits, CHUNK)

    def run(new: pa.Table, old: pa.Table) -> pa.Table:
        data = np.zeros(1 << (width - 3), np.uint8)
        for held in old["data"]:
            data |= np.frombuffer(held.as_buffer(), np.uint8)
        slot = new["slot"].to_numpy() & ((1 << width) - 1)
        np.bitwise_or.at(data, slot >> 3, np.left_shift(1, slot & 7).astype(np.uint8))
        chunk = (new["chunk"] if new.num_rows else old["chunk"])[0].as_py()
        return pa.table([pa.array([chunk], pa.int64()), pa.array([data.tobytes()], pa.binary())], names=["chunk", "data"])

    return run


def frequent(spark: SparkSession, dealt: str, root: str, shards: int, longest: int, least: int) -> tuple[str | None, int]:
    """(filter, its bits) of the names of all words and phrases that are found ``least`` times in the texts below ``dealt`` (lang, text, a folder a shard), by dynamic counting."""
    filters: list[str | None] = [None]  # at the start of each step
    bits, running, step = FEW_BITS, None, 0
    while True:
        before = filters[step - shards] if step >= shards else None
        if step >= shards and filters[step] == before:
            return filters[step], bits  # a whole cycle without anything new
        shard = spark.read.schema("lang string, text string, shard int").parquet(dealt).filter(F.col("shard") == step % shards).select("lang", "text")
        counted = shard.mapInArrow(_scan(filters[step], before, bits, step < shards, longest), "name long, n long").withColumn("since", F.lit(step))
        if running is not None:
            counted = counted.unionByName(running.select("name", "n", "since"))
        sums = materialise(counted.groupBy("name").agg(F.sum("n").alias("n"), F.min("since").alias("since")), f"{root}/sums-{step}")
        reached = sums.filter(F.col("n") >= least).select("name")
        if step == 0:
            words = sums.agg(F.sum("n")).first()[0] or 0
            bits = int(min(MOST_BITS, max(FEW_BITS, np.ceil(np.log2(BITS_A_KEY * longest * shards * max(1, words) / least)))))
        slots = reached.select(F.shiftrightunsigned("name", 64 - bits).alias("slot")).withColumn("chunk", F.shiftright("slot", min(bits, CHUNK)))
        filters.append(filters[step])
        if not slots.isEmpty():
            old = spark.read.schema("chunk long, data binary").parquet(filters[step]) if filters[step] else spark.createDataFrame([], "chunk long, data binary")
            filters[step + 1] = f"{root}/filter-{step + 1}"
            slots.groupBy("chunk").cogroup(old.groupBy("chunk")).applyInArrow(_bits_of(bits), "chunk long, data binary").write.parquet(filters[step + 1])
        # what has been counted since step s ends its cycle at s + shards - 1 at the latest
        running = sums.filter((F.col("n") < least) & (F.col("since") + shards - 1 > step))
        if step > 0:
            delete(spark, f"{root}/sums-{step - 1}")
        step += 1


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS) -> DataFrame:
    """(lang, length, phrase, n) of all words and phrases of up to ``longest`` words found ``least`` times in their language, exactly; under length 0 a language's words."""
    root = workspace(docs.sparkSession, "phrases")
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    rows.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int")).write.partitionBy("shard").option("compression", "zstd").parquet(f"{root}/dealt")
    uri, bits = frequent(docs.sparkSession, f"{root}/dealt", root, shards, longest, least)
    # what a task names, others name too: this scan takes its input in fewer, larger parts
    wide = rows.coalesce(max(2 * docs.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions() // 4))
    named = wide.mapInArrow(_named(uri, bits, longest), NAMED).groupBy("lang", "length", "name", "check").agg(F.sum("n").alias("n"), F.max("phrase").alias("phrase"))
    return materialise(named.filter((F.col("n") >= least) | (F.col("length") == 0)).select("lang", "length", "phrase", "n"), f"{root}/phrases")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    A phrase of which ``covered`` percent lie within one longer phrase is left out; its score is that of its worst cut.
    """
    held = phrases(docs, text, lang, least, longest, shards)
    known = held.filter("length > 0").select("lang", "phrase", F.col("n").alias("f"))
    found = held.filter("length > 1").select("lang", "length", "phrase", F.col("n").alias("a"))
    part = lambda w, at, k: F.array_join(F.slice(w, at, k), " ")
    word = F.split("phrase", " ")
    spans = [(k, at) for k in range(2, longest) for at in range(1, longest)]
    inside = found.filter("length > 2").select("lang", "a", F.explode(F.filter(F.array(*[F.when((F.lit(k) < F.col("length")) & (at + k - 1 <= F.col("length")), part(word, at, k)) for k, at in spans]), lambda x: x.isNotNull())).alias("phrase")) if longest > 2 else None
    if inside is not None:
        cover = inside.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
        found = found.join(cover, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (F.col("most").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * covered)).drop("most")
    cuts = found.select("lang", "phrase", "a", F.explode(F.filter(F.array(*[F.when(F.col("length") > k, F.struct(F.lit(k).alias("k"), part(word, 1, k).alias("first"), F.expr(f"array_join(slice(split(phrase, ' '), {k + 1}, {longest}), ' ')").alias("rest"))) for k in range(1, longest)]), lambda x: x.isNotNull())).alias("c"))
    cuts = cuts.select("lang", "phrase", "a", "c.*")
    both = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    scored = both.withColumn("score", F.expr("cast(cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + r) as bigint)"))
    worst = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("w")).select("lang", "phrase", "w.a", "w.l", "w.r", "w.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = worst.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    totals = held.filter("length = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _oracle() -> str:
    chars = "[.,;:!?\\x0A-\\x0D]"
    grams = " union all ".join(f"select lang, {k} as length, array_to_string(w[i:i+{k - 1}], ' ') as phrase from (select lang, w, unnest(generate_series(1, len(w) - {k - 1})) as i from words where len(w) >= {k})" for k in range(1, LONGEST + 1))
    spans = " union all ".join(f"select lang, a, array_to_string(string_split(phrase, ' ')[{at}:{at + k - 1}], ' ') as phrase from c where length > {k} and length >= {at + k - 1}" for k in range(2, LONGEST) for at in range(1, LONGEST))
    cuts = " union all ".join(f"select lang, phrase, a, {k} as k, array_to_string(string_split(phrase, ' ')[1:{k}], ' ') as first, array_to_string(string_split(phrase, ' ')[{k + 1}:], ' ') as rest from kept where length > {k}" for k in range(1, LONGEST))
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{up}', '{low}'), '{chars}')) as p from documents),
words as (select lang, regexp_extract_all(p, '[^\\x20\\x09]+') as w from pieces),
g as ({grams}),
f as (select lang, length, phrase, count(*) as n from g group by all having count(*) >= {LEAST}),
total as (select lang, sum(len(w))::bigint as n from words group by 1),
c as (select lang, length, phrase, n as a from f where length > 1),
cover as (select lang, phrase, max(a) as most from ({spans}) group by all),
kept as (select c.* from c left join cover using (lang, phrase) where most is null or most::hugeint * 100 < a::hugeint * {COVERED}),
cut as ({cuts}),
scored as (select cut.lang, cut.phrase, a, k, x.n as l, y.n as r, ((a::hugeint * 2000000) // (x.n + y.n))::bigint as score from cut join f x on x.lang = cut.lang and x.phrase = cut.first join f y on y.lang = cut.lang and y.phrase = cut.rest),
worst as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from worst)
select ranked.lang, rank, phrase, a, l, r, total.n as n, score from ranked join total using (lang) where rank <= {TOP}
"""


ORACLE_OP12 = _oracle()


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))
