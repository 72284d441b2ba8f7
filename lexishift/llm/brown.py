"""Language-model scores from Brown classes: exchange clustering, class transitions and word emissions.

Tasks encode the texts they read, without a shuffle, into blocks of ``BLOCK_BYTES`` of hashes; a block is one row of a written
table: its distinct words (sorted 64-bit hashes), how often each stands in training texts, and its texts as places in that
list. Every later pass works on these integers. What blocks and words tell each other travels in slices: the hashes fall
into even ranges (parts), and a block's words of one part are one row of packed arrays, so Spark shuffles few rows.

1. Word counts summed over all blocks give N, V, and the ``CORE`` most frequent words.
2. Bigram counts among core words (everything else is one more symbol) make a table of fixed size, on which exchange
   clustering moves words between ``CLASSES`` classes while the likelihood of class bigrams grows. It is only the start.
3. Exchange passes over the whole vocabulary: each block counts the classes beside each of its words, the counts of a
   word are summed over all blocks, and every word is offered the class with the greatest exact gain. Class bigrams are
   counted anew before each pass. In the first pass all words move; later, as words that move at once can undo each other, every
   second one by turns. Passes end after ``PASSES``, or when words that would move hold the share ``STILL`` of the
   training tokens at most; a pass that has lowered the likelihood is taken back and is the last.
4. Each block gets the class and count of its words; class bigrams are counted once more, and texts are scored.

P(word | previous) = (1 - u) P(class | previous class) P(word | class); transitions are smoothed towards the class
frequencies; all unknown words are one type of probability u, the share of words seen once (Good-Turing).

Defined results: a null text is empty (one end token); a null ``doc_id`` counts as a training text; repeated rows count
as often as they occur; with no training text all words are unknown; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexishift.llm.storage import delete, materialise, task_fs, workspace

BLOCK_BYTES, PART_WORDS, CORE, CLASSES, SWEEPS = 16 << 20, 100_000, 512, 64, 6
TOGETHER = 256  # blocks (or sums of so many) of a part of the words that a task sums up
FOLDS, HELD = 7, 2
PASSES, STILL = 4, 0.01
SMALL, AT_ONCE = 4, 2048  # counts up to SMALL have their gains in a table; words whose gains are computed together
END = xxhash.xxh3_64_intdigest(b"end of text")  # no word has a blank, so no word is this
BLOCK = "block long, n_words long, words binary, counts binary, seq binary, doc_ids array<long>, lens array<int>, held array<boolean>"
BLOCK_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_())]
BLOCK_NAMES = [x.split()[0] for x in BLOCK.split(", ")]


def _blocks(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, ids, hashes, lens, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def row() -> pa.RecordBatch:
            held = [i is not None and zlib.crc32(str(i).encode()) % FOLDS == HELD for i in ids]
            words, places = np.unique(np.concatenate(hashes), return_inverse=True)
            counts = np.bincount(places[np.repeat(~np.array(held), lens)], minlength=len(words)).astype("<i8")
            values = [task << 32 | seq, len(words), words.tobytes(), counts.tobytes(), places.astype("<u4").tobytes(), ids, lens, held]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, BLOCK_TYPES, strict=True)], names=BLOCK_NAMES)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
                hashes += [h, np.array([END], np.uint64)]
                ids.append(doc_id)
                lens.append(len(words) + 1)
                size += 8 * len(words) + 8
                if size >= block_bytes:
                    yield row()
                    seq, ids, hashes, lens, size = seq + 1, [], [], [], 0
        if ids:
            yield row()

    return run


def _array(value: pa.Scalar, kind: str) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def _training(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, seq, whether a token is trained on, whether it starts a text) of row ``i``."""
    lens = batch.column("lens")[i].values.to_numpy()
    train = np.repeat(~batch.column("held")[i].values.to_numpy(zero_copy_only=False), lens)
    first = np.zeros(len(train), bool)
    first[np.concatenate([[0], np.cumsum(lens)[:-1]])] = True
    return _array(batch.column("words")[i], "<u8"), _array(batch.column("seq")[i], "<u4"), train, first


def _codes(words: np.ndarray, core: np.ndarray, other: int) -> np.ndarray:
    """Place of each word in the sorted ``core``, or ``other``."""
    if not len(core):
        return np.full(len(words), other)
    at = np.minimum(np.searchsorted(core, words), len(core) - 1)
    return np.where(core[at] == words, at, other)


def exchange(pairs: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each symbol: symbols move to the class that raises the likelihood of class bigrams most, until none does."""
    n = len(pairs)
    label = np.arange(n) % classes
    hot = np.eye(classes)[label]
    big, out, inn = hot.T @ pairs @ hot, hot.T @ pairs, pairs @ hot  # out[c, w]: c before w; inn[w, c]: w before c
    f = _xlogx
    for _ in range(sweeps):
        moved = 0
        for w in range(n):
            a, own = label[w], pairs[w, w]
            row, col = inn[w].copy(), out[:, w].copy()
            row[a] -= own
            col[a] -= own
            if row.sum() + col.sum() + own == 0:
                continue
            big[a] -= row
            big[:, a] -= col
            big[a, a] -= own
            left, right = big.sum(1) + col, big.sum(0) + row  # wherever w goes, its neighbours keep their totals
            gain = (f(big + row[None, :]) - f(big)).sum(1) + (f(big.T + col[None, :]) - f(big.T)).sum(1)
            d = np.diag(big)
            gain += f(d + row + col + own) - f(d + row) - f(d + col) + f(d)
            gain -= f(left + row.sum() + own) - f(left) + f(right + col.sum() + own) - f(right)
            b = int(gain.argmax())
            b = a if gain[b] <= gain[a] + 1e-9 else b
            big[b] += row
            big[:, b] += col
            big[b, b] += own
            if a != b:
                label[w] = b
                out[a] -= pairs[w]
                out[b] += pairs[w]
                inn[:, a] -= pairs[:, w]
                inn[:, b] += pairs[:, w]
                moved += 1
        if not moved:
            break
    return label


def transition_logs(counts: np.ndarray) -> np.ndarray:
    """Natural logs of P(next class | class), smoothed towards the frequencies of the next class."""
    n = len(counts)
    prior = (counts.sum(0) + 1) / (counts.sum() + n)
    return np.log((counts + n * prior[None, :]) / (counts.sum(1, keepdims=True) + n))


def step_logs(big: np.ndarray, unknown: float) -> np.ndarray:
    """log10 of P(next kind | kind): the classes, then the one unknown type, which tells nothing of what follows it."""
    after_unknown = np.log((big.sum(0) + 1) / (big.sum() + len(big)))[None]
    known = np.vstack([transition_logs(big), after_unknown]) / np.log(10) + np.log10(1 - unknown)
    return np.hstack([known, np.full((len(known), 1), np.log10(unknown))])


def likelihood(big: np.ndarray) -> float:
    """The part of the class bigrams' log-likelihood that depends on the classes."""
    return float(_xlogx(big).sum() - _xlogx(big.sum(1)).sum() - _xlogx(big.sum(0)).sum())


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def ring(seq: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places before and after each token. A text is a ring: before its first token and after its last stands its end token."""
    n = len(seq)
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], n) - 1
    before, after = np.arange(-1, n - 1, dtype=np.int32), np.arange(1, n + 1, dtype=np.int32)
    before[starts], after[ends] = ends, starts
    return before, after


def class_pairs(label: np.ndarray, seq: np.ndarray, train: np.ndarray, first: np.ndarray, classes: int) -> np.ndarray:
    """Class bigrams of a block whose word ``i`` has class ``label[i]``."""
    before, _ = ring(seq, first)
    kinds = label[seq].astype(np.int32)
    return np.bincount((kinds[before] * classes + kinds)[train], minlength=classes * classes)


def neighbour_counts(label: np.ndarray, seq: np.ndarray, train: np.ndarray, first: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(how many keys each word of the block has, all their keys, how often each stands in training texts).

    Key c counts class c before a word, classes + c class c after it, and 2 * classes the word beside itself.
    """
    keys = 2 * classes + 1
    before, after = ring(seq, first)
    kind = np.uint32 if len(label) * keys < 2**32 else np.int64
    word, before, after = seq[train].astype(kind), seq[before[train]], seq[after[train]]
    left = word * kind(keys) + np.where(before == word, 2 * classes, label[before]).astype(kind)
    other = after != word
    right = word[other] * kind(keys) + (label[after[other]].astype(kind) + kind(classes))
    key, count = np.unique(np.concatenate([left, right]), return_counts=True)
    return np.bincount(key // kind(keys), minlength=len(label)).astype("<u4"), (key % kind(keys)).astype(np.uint8), count.astype("<u4")


class Gains:
    """Exact gains in likelihood of words in each class, once they have left their own, for class bigrams ``big``."""

    def __init__(self, big: np.ndarray):
        self.big, self.classes = big, len(big)
        self.sides = []
        for table in (big.T, big):  # table[e, c]: class c beside class e
            up = np.stack([_xlogx(table + m) - _xlogx(table) for m in range(SMALL + 1)])
            down = np.stack([_xlogx(table) - _xlogx(np.maximum(table - m, 0)) for m in range(SMALL + 1)])
            self.sides.append((table, up, down))
        self.d, self.left, self.right = np.diag(big).copy(), big.sum(1), big.sum(0)

    def __call__(self, counts: np.ndarray, was: np.ndarray) -> np.ndarray:
        """A row a word: ``counts`` by key, ``was`` its class now."""
        n, classes = len(counts), self.classes
        col, row, own, every = counts[:, :classes], counts[:, classes : 2 * classes], counts[:, 2 * classes], np.arange(n)
        gain = np.zeros((n, classes))
        for side, back, (table, up, down) in ((row, col, self.sides[0]), (col, row, self.sides[1])):
            i, e = np.nonzero(side)
            if not len(i):
                continue
            m = side[i, e].astype(np.int64)
            simple = (e != was[i]) & (m <= SMALL)
            value = np.empty((len(i), classes))
            s = np.flatnonzero(simple)
            value[s] = up[m[s], e[s]]
            value[s, was[i[s]]] = down[m[s], e[s], was[i[s]]]  # there the word's own share has left first
            r = np.flatnonzero(~simple)
            base, many = table[e[r]], m[r][:, None].astype(float)
            base[np.arange(len(r)), was[i[r]]] -= many[:, 0]
            home = np.flatnonzero(e[r] == was[i[r]])
            base[home] -= back[i[r][home]]
            base[home, e[r][home]] -= own[i[r][home]]
            value[r] = _xlogx(base + many) - _xlogx(base)
            who, at = np.unique(i, return_index=True)
            gain[who] += np.add.reduceat(value, at, axis=0)
        both = row + col
        i, c = np.nonzero(both + own[:, None])
        mine = c == was[i]
        d = self.d[c] - mine * (both[i, c] + own[i])
        gain[i, c] += _xlogx(d + both[i, c] + own[i]) - _xlogx(d + row[i, c]) - _xlogx(d + col[i, c]) + _xlogx(d)
        for total, size in ((self.left, row.sum(1) + own), (self.right, col.sum(1) + own)):
            sizes, which = np.unique(size, return_inverse=True)
            rise = _xlogx(total[None] + sizes[:, None]) - _xlogx(total)[None]
            fall = _xlogx(total)[None] - _xlogx(total[None] - np.minimum(sizes[:, None], total[None]))
            own_rise = rise[which]
            own_rise[every, was] = fall[which, was]
            gain -= own_rise
        return gain


def _slices(words: np.ndarray, parts: int) -> np.ndarray:
    """Where each part's words start, and the last one's end, in a block's sorted words."""
    edges = np.array([-(-(k << 64) // parts) for k in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(words, edges), [len(words)]])


def _rows(block: int, at: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """One row a part of a block that has words there: ``columns`` are arrays with one entry a word, cut at ``at``."""
    used = np.flatnonzero(at[1:] > at[:-1])
    arrays = [pa.array(used, pa.int32()), pa.array(np.full(len(used), block), pa.int64())]
    for a in columns.values():
        data, size = a.tobytes(), a.itemsize
        arrays.append(pa.array([data[size * at[p] : size * at[p + 1]] for p in used], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=["p", "block", *columns])


def _joined(table: pa.Table, name: str, kind) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a column of packed arrays, and how many each row has."""
    parts = table.column(name).to_pylist()
    flat = np.frombuffer(b"".join(parts), kind)
    return flat, np.array([len(x) for x in parts], np.int64) // flat.itemsize


VOCABULARY = "p int, words binary, counts binary"


def _summed(key, table):
    """The words of a part that stand in training texts, and their counts over all blocks."""
    (words, _), (counts, _) = _joined(table, "words", "<u8"), _joined(table, "counts", "<i8")
    distinct, which = np.unique(words, return_inverse=True)
    total = np.bincount(which, counts, len(distinct)).astype("<i8")
    seen = total > 0
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([distinct[seen].tobytes()]), pa.array([total[seen].tobytes()])], names=["p", "words", "counts"])


def _pooled(key, table):
    """Several rows of neighbour counts of a part's words as one, with counts of 64 bits."""
    (words, _), (was, _), (sizes, _) = _joined(table, "words", "<u8"), _joined(table, "label", np.uint8), _joined(table, "sizes", "<u4")
    k, n = _neighbours(table)
    distinct, first, which = np.unique(words, return_index=True, return_inverse=True)
    who = np.repeat(which, sizes).astype(np.int64) << 8 | k
    pair, place = np.unique(who, return_inverse=True)
    total = np.zeros(len(pair), np.int64)
    np.add.at(total, place, n)
    size = np.bincount(pair >> 8, minlength=len(distinct)).astype("<u4")
    data = {"words": distinct, "label": was[first], "sizes": size, "keys": (pair & 255).astype(np.uint8), "n": total}
    return pa.table([pa.array([key[0].as_py()], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in data.values()]], names=["p", *data])


POOLED = "p int, words binary, label binary, sizes binary, keys binary, n binary"


def _neighbours(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of all rows; counts are of 32 bits as blocks give them, of 64 once summed."""
    keys, counts = table.column("keys").to_pylist(), table.column("n").to_pylist()
    n = [np.frombuffer(y, "<u4" if len(y) == 4 * len(x) else "<i8").astype(np.int64) for x, y in zip(keys, counts, strict=True)]
    return np.frombuffer(b"".join(keys), np.uint8), np.concatenate(n) if n else np.zeros(0, np.int64)


def pooled(df: DataFrame, groups: int, together: int, combine, schema: str) -> DataFrame:
    """Rows (p, g, ...) of the parts' blocks, combined within their groups g, ``together`` groups at a time, until each part has one group: no task takes in more than that many."""
    while groups > 1:

        def run(key, table):
            out = combine(key, table)
            return out.append_column("g", pa.array([key[1].as_py()] * out.num_rows, pa.int64()))

        df = df.groupBy("p", "g").applyInArrow(run, schema + ", g long")
        groups = -(-groups // together)
        df = df.withColumn("g", F.pmod("g", F.lit(groups)))
    return df


def _relabelled(key, left, right):
    """The classes that the words of each block's slice (left) go to, from those of the part (right)."""
    (words, _), (label, _) = _joined(right, "words", "<u8"), _joined(right, "label", np.uint8)
    asked, per = _joined(left, "words", "<u8")
    data, at = label[np.searchsorted(words, asked)].tobytes(), np.concatenate([[0], np.cumsum(per)]).tolist()
    return pa.table([left.column("p"), left.column("block"), pa.array([data[x:y] for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["p", "block", "label"])


LABELS = "p int, block long, label binary, words binary, counts binary, was binary, moved long"


def _decided(big: np.ndarray, turn: int):
    """A part's words, each with its class now, its count and the class it goes to; and every block's slice of new classes, or where counts come summed over blocks,
    under block -1 the classes of all its words."""
    classes = len(big)
    keys, gains = 2 * classes + 1, Gains(big)

    def run(key, table):
        (words, per), (was, _), (sizes, _) = _joined(table, "words", "<u8"), _joined(table, "label", np.uint8), _joined(table, "sizes", "<u4")
        k, n = _neighbours(table)
        distinct, first, which = np.unique(words, return_index=True, return_inverse=True)
        order = np.argsort(np.repeat(which, sizes), kind="stable")
        who, k, n = np.repeat(which, sizes)[order], k[order], n[order]
        was = was[first].astype(np.int64)
        best, count = was.copy(), np.zeros(len(distinct), np.int64)
        for a in range(0, len(distinct), AT_ONCE):
            b = min(a + AT_ONCE, len(distinct))
            lo, hi = np.searchsorted(who, [a, b])
            counts = np.bincount((who[lo:hi] - a) * keys + k[lo:hi], n[lo:hi], (b - a) * keys).reshape(-1, keys)
            gain, every = gains(counts, was[a:b]), np.arange(b - a)
            to = gain.argmax(1)
            best[a:b] = np.where(gain[every, to] > gain[every, was[a:b]] + 1e-9, to, was[a:b])
            count[a:b] = counts[:, :classes].sum(1) + counts[:, -1]
        goes = np.ones(len(distinct), bool) if turn == 0 else (distinct & np.uint64(1)) == turn % 2
        label = np.where(goes, best, was).astype(np.uint8)
        data, at = label[which].tobytes(), np.concatenate([[0], np.cumsum(per)]).tolist()
        blocks = table.column("block").to_pylist() if "block" in table.column_names else [-1]
        if blocks == [-1]:
            data, at = label.tobytes(), [0, len(label)]
        every_word = [distinct.tobytes()] if blocks == [-1] else [None] * len(blocks)
        moved = int(count[best != was].sum())
        own = [key[0].as_py()] * (len(blocks) + 1)
        seen = count > 0
        return pa.table(
            [
                pa.array(own, pa.int32()), pa.array([*blocks, None], pa.int64()), pa.array([*[data[x:y] for x, y in zip(at[:-1], at[1:], strict=True)], label[seen].tobytes()], pa.binary()),
                pa.array([*every_word, distinct[seen].tobytes()], pa.binary()), pa.array([None] * len(blocks) + [count[seen].astype("<i8").tobytes()], pa.binary()),
                pa.array([None] * len(blocks) + [was[seen].astype(np.uint8).tobytes()], pa.binary()), pa.array([None] * len(blocks) + [moved], pa.int64()),
            ],
            names=["p", "block", "label", "words", "counts", "was", "moved"],
        )

    return run


def _writer(folder: str, columns: list[str]):
    """Writes a block's slices, in the order of its words, as one file below ``folder``: one column after another."""

    def run(key, table):
        table = table.sort_by("p")
        fs, base = task_fs(folder)
        fs.create_dir(base, recursive=True)
        name = f"{base}/{key[0].as_py()}"
        temporary = f"{name}-{uuid.uuid4().hex}"
        with fs.open_output_stream(temporary) as out:
            for c in columns:
                out.write(b"".join(table.column(c).to_pylist()))
        fs.move(temporary, name)
        return pa.table({"block": [key[0].as_py()]})

    return run


def _read(folder: str, block: int) -> bytes:
    fs, base = task_fs(folder)
    with fs.open_input_stream(f"{base}/{block}", compression=None) as f:
        return f.read()


def score_documents(docs: DataFrame, block_bytes: int = BLOCK_BYTES, core_words: int = CORE, classes: int = CLASSES, passes: int = PASSES, together: int = TOGETHER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs`` (doc_id, text)."""
    spark: SparkSession = docs.sparkSession
    root = workspace(spark, "brown")
    table = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_blocks(block_bytes), BLOCK), f"{root}/blocks")
    n_blocks, n_words = table.agg(F.count("*"), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    parts, groups = int(n_words // PART_WORDS) + 1, max(1, -(-n_blocks // together))
    group = F.pmod(F.xxhash64("block"), F.lit(groups)).cast("long").alias("g")
    for_each_group = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g")

    def counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, counts in zip(*batch.columns, strict=True):
                w = _array(words, "<u8")
                yield _rows(block.as_py(), _slices(w, parts), words=w, counts=_array(counts, "<i8"))

    told = table.select("block", "words", "counts").mapInArrow(counted_words, "p int, block long, words binary, counts binary")
    summed = pooled(told.select("p", group, "words", "counts"), groups, together, _summed, VOCABULARY)
    vocabulary = materialise(summed.groupBy("p").applyInArrow(_summed, VOCABULARY), f"{root}/vocabulary")

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                c = _array(x, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array([int(c.sum())]), pa.array([len(c)]), pa.array([int((c == 1).sum())])], names=["total", "distinct", "once"])

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, counts in zip(*batch.columns, strict=True):
                w, c = _array(words, "<u8"), _array(counts, "<i8")
                top = np.lexsort((w, -c))[:core_words]
                yield pa.RecordBatch.from_arrays([pa.array(w[top].view(np.int64)), pa.array(c[top])], names=["h", "c"])

    sums = vocabulary.select("counts").mapInArrow(figures, "total long, distinct long, once long")
    total, distinct, once = sums.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in ("total", "distinct", "once")]).first()
    top = vocabulary.select("words", "counts").mapInArrow(frequent, "h long, c long").orderBy(F.desc("c"), "h").limit(core_words).collect()  # core_words rows
    core = np.sort(np.array([r.h for r in top], np.int64).view(np.uint64))
    other = len(core)

    def gathered(df: DataFrame, side: int) -> np.ndarray:
        """The sum of tables of ``side`` * ``side`` numbers, one a task."""
        out = np.zeros(side * side)
        for at, n in df.groupBy("at").agg(F.sum("n")).collect():  # side^2 numbers at most
            out[at] = n
        return out.reshape(side, side)

    def tabled(side: int, one):
        """Bigrams of all blocks of a task, as ``one`` (batch, row) counts a block's."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(side * side, np.int64)
            for batch in batches:
                for i in range(batch.num_rows):
                    sums += one(batch, i)
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["at", "n"])

        return run

    def core_pairs(batch: pa.RecordBatch, i: int) -> np.ndarray:
        words, seq, train, first = _training(batch, i)
        return class_pairs(_codes(words, core, other), seq, train, first, other + 1)

    lean = table.select("block", "words", "seq", "lens", "held")
    start = exchange(gathered(lean.mapInArrow(tabled(other + 1, core_pairs), "at long, n long"), other + 1), classes).astype(np.uint8)
    folder: str | None = None

    def labels_in(folder: str | None):
        """Classes of a block's words: what the last pass has written, or those of the core words and of all others at the start."""
        if folder is None:
            return lambda block, words: start[_codes(words, core, other)]
        return lambda block, words: np.frombuffer(_read(folder, block), np.uint8, len(words))

    def bigrams(labels) -> np.ndarray:
        def one(batch: pa.RecordBatch, i: int) -> np.ndarray:
            words, seq, train, first = _training(batch, i)
            return class_pairs(labels(batch.column("block")[i].as_py(), words), seq, train, first, classes)

        return gathered(lean.mapInArrow(tabled(classes, one), "at long, n long"), classes)

    def counted(labels) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    words, seq, train, first = _training(batch, i)
                    block = batch.column("block")[i].as_py()
                    own = labels(block, words)
                    sizes, keys, n = neighbour_counts(own, seq, train, first, classes)
                    at = _slices(words, parts)
                    rows = _rows(block, at, words=words, label=own, sizes=sizes)
                    key_at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[at]
                    used = np.flatnonzero(at[1:] > at[:-1])
                    for name, x in (("keys", keys), ("n", n)):
                        data, size = x.tobytes(), x.itemsize
                        rows = rows.append_column(name, pa.array([data[size * key_at[p] : size * key_at[p + 1]] for p in used], pa.binary()))
                    yield rows

        return lean.mapInArrow(run, "p int, block long, words binary, label binary, sizes binary, keys binary, n binary")

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words in zip(*batch.columns, strict=True):
                w = _array(words, "<u8")
                yield _rows(block.as_py(), _slices(w, parts), words=w)

    def words_of_blocks() -> DataFrame:
        return table.select("block", "words").mapInArrow(asked, "p int, block long, words binary")

    known, settled, best, turn = None, total == 0, -np.inf, 0
    while not settled:
        big = bigrams(labels_in(folder))
        reached = likelihood(big)
        if reached < best:  # words that moved at once undid each other
            known = decided.filter("block is null").select("p", "words", "counts", F.col("was").alias("label"))
            break
        best = reached
        if turn == passes:
            break
        counts = counted(labels_in(folder))
        if groups > 1:
            counts = pooled(counts.select("p", group, "words", "label", "sizes", "keys", "n"), groups, together, _pooled, POOLED).drop("g")
        decided = materialise(counts.groupBy("p").applyInArrow(_decided(big, turn), LABELS), f"{root}/decided-{turn}")
        wish = decided.agg(F.coalesce(F.sum("moved"), F.lit(0))).first()[0]
        known = decided.filter("block is null").select("p", "words", "counts", "label")
        folder = f"{root}/labels-{turn}"
        slices = decided.filter("block is not null").select("p", "block", "label")
        if groups > 1:
            to = decided.filter("block = -1").select("p", for_each_group, "words", "label")
            slices = words_of_blocks().select("p", group, "block", "words").groupBy("p", "g").cogroup(to.groupBy("p", "g")).applyInArrow(_relabelled, "p int, block long, label binary")
        slices.groupBy("block").applyInArrow(_writer(folder, ["label"]), "block long").write.format("noop").mode("overwrite").save()
        turn, settled = turn + 1, wish <= STILL * total

    in_class = np.zeros(classes)
    if known is None:
        known = spark.createDataFrame([], "p int, words binary, counts binary, label binary")

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(classes, np.int64)
        for batch in batches:
            for counts, label in zip(*batch.columns, strict=True):
                sums += np.bincount(_array(label, np.uint8), _array(counts, "<i8"), classes).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes)), pa.array(sums)], names=["at", "n"])

    for k, n in known.select("counts", "label").mapInArrow(by_class, "at long, n long").groupBy("at").agg(F.sum("n")).collect():  # a row a class
        in_class[k] = n

    def matched(key, left, right):
        """Class and count of the words of each block's slice; class ``classes`` where a word is unknown."""
        (words, _), (counts, _), (label, _) = _joined(right, "words", "<u8"), _joined(right, "counts", "<i8"), _joined(right, "label", np.uint8)
        asked, per = _joined(left, "words", "<u8")
        code = _codes(asked, words, len(words))
        kind, count = np.append(label, np.uint8(classes))[code].tobytes(), np.append(counts, 0).astype("<i8")[code].tobytes()
        at = np.concatenate([[0], np.cumsum(per)]).tolist()
        cut = lambda data, size: pa.array([data[size * x : size * y] for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())
        return pa.table([left.column("p"), left.column("block"), cut(kind, 1), cut(count, 8)], names=["p", "block", "label", "counts"])

    end_kind, final = _end_class(known), f"{root}/final"
    slices = words_of_blocks().select("p", group, "block", "words")
    each = known.select("p", for_each_group, "words", "counts", "label")
    met = slices.groupBy("p", "g").cogroup(each.groupBy("p", "g")).applyInArrow(matched, "p int, block long, label binary, counts binary")
    met.groupBy("block").applyInArrow(_writer(final, ["label", "counts"]), "block long").write.format("noop").mode("overwrite").save()

    def last_labels(block: int, words: np.ndarray) -> np.ndarray:
        return np.frombuffer(_read(final, block), np.uint8, len(words))

    big = bigrams(last_labels) if total else np.zeros((classes, classes))  # words of training texts are all known
    for old in range(turn):
        delete(spark, f"{root}/decided-{old}")
        delete(spark, f"{root}/labels-{old}")
    unknown = (once + 1) / (total + 2)
    step = step_logs(big, unknown)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, seq, _, first = _training(batch, i)
                data = _read(final, batch.column("block")[i].as_py())
                kind, count = np.frombuffer(data, np.uint8, len(words)), np.frombuffer(data, "<i8", len(words), len(words))
                base = np.log10((count + 1) / (total + distinct + 1))
                emit = np.where(count > 0, np.log10(np.maximum(count, 1) / np.maximum(np.append(in_class, 1)[kind], 1)), 0.0)
                starts = np.flatnonzero(first)
                sums = lambda x: np.add.reduceat(x, starts)
                kinds = kind[seq]
                before = np.where(first, end_kind, np.concatenate([[0], kinds[:-1]]))
                lens = np.diff(np.append(starts, len(seq)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_ids")[i].values, batch.column("held")[i].values, pa.array(lens.astype(np.int64)), pa.array(sums((count > 0)[seq].astype(np.int64))),
                        pa.array(np.full(len(lens), total, np.int64)), pa.array(sums(base[seq])), pa.array(sums(step[before, kinds] + emit[seq])),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    whole = table.select("block", "words", "seq", "doc_ids", "lens", "held")
    return whole.mapInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _end_class(known: DataFrame) -> int:
    """The class of the end token; 0 without training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, label in zip(*batch.columns, strict=True):
                at = np.flatnonzero(_array(words, "<u8") == np.uint64(END))
                yield pa.RecordBatch.from_arrays([pa.array(_array(label, np.uint8)[at].astype(np.int64))], names=["k"])

    found = known.select("words", "label").mapInArrow(run, "k long").first()
    return int(found[0]) if found else 0


def op8_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
