r"""Byte-pair encoding by a tokenization automaton, and decoding by its arc labels.

The automaton's alphabet is the vocabulary; a path spells a text and is accepted if it is the text's encoding. It is
deterministic: the state after a path follows from its last token. :func:`compile_merges` builds it from one state
with a loop for every byte by one gadget a merge, in the order of the merges. Merge (u, v) -> w:

* the state after u is split off from the states of other tokens, and v may no longer follow it;
* w may follow wherever u may (after the removal, which settles runs such as a a a leftmost);
* the state after w is what the state after v was.

A state's arcs are one row of bits over *places*, and each token's place lies in an interval that holds the places of
all tokens later made with it on the left, latest merges first. A token that does not exist yet so lies where its left
part lies, and "w wherever u" costs nothing: the interval of u just ends before w from then on. A gadget therefore
clears one interval of one row. States with equal rows are merged at the end.

Words are encoded in blocks by table-driven transitions: from every byte of every word at once, a byte trie of the vocabulary
is walked, and a token that is spelled there is taken if the state before it has its arc. Every prefix of a word has one
accepted path, so the token that ends at each byte is found from left to right, and read back from the word's end.

Defined results: a null text is empty (no ids); a null ``doc_id`` is kept; repeated rows give repeated results;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexishift.llm.tokens import Pieces, cut, groups, taken, vocabulary_path

TOKENIZER = "byte_bpe_50k.json"
# Fixed value: the pre-tokenizer's pattern of byte-level vocabularies.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
LONG_WORD, ROOT = 64, 1  # words of more bytes are walked one by one; the first node of a trie


def byte_names() -> dict[str, int]:
    """The printable stand-in of each byte: itself where Latin-1 prints it, else the next code point from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def intervals(size: int, merges: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """(place, end) of each token: its interval holds itself, then the tokens made with it on the left, latest first."""
    later: list[list[int]] = [[] for _ in range(size)]
    inner = [False] * size
    for u, _, w in merges:
        later[u].append(w)
        inner[w] = True
    place, end, at = [0] * size, [0] * size, 0
    for root in range(size):
        if inner[root]:
            continue
        stack = [(root, True)]
        while stack:
            t, enter = stack.pop()
            if not enter:
                end[t] = at
                continue
            place[t], at = at, at + 1
            stack.append((t, False))
            stack += [(w, True) for w in later[t]]  # the last is entered first
    return place, end


def compile_merges(size: int, merges: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(arcs, state, place, made, start) of the automaton of tokens 0 to ``size`` - 1 and ``merges`` (u, v, w) in order.

    Bit ``place[t]`` of row ``state[s]`` of ``arcs`` tells whether t may follow s; ``start`` is the state before any token.
    A token that no merge can make, as its parts never meet when its turn comes, is not ``made`` and must not be taken.
    """
    place, end = intervals(size, merges)
    whole = (1 << size) - 1
    row: list[int | None] = [whole] * size
    made = np.ones(size, bool)
    for _, _, w in merges:
        row[w], made[w] = None, False
    for u, v, w in merges:
        after_u, after_v = row[u], row[v]
        if after_u is None or after_v is None or not after_u >> place[v] & 1:
            continue
        row[u] = after_u & ~(((1 << (end[v] - place[v])) - 1) << place[v])
        row[w], made[w] = after_v, True
        end[u] = place[w]
    number: dict[int, int] = {whole: 0}
    state = np.array([number.setdefault(whole if r is None else r, len(number)) for r in row], np.int32)
    width = -(-size // 8)
    arcs = np.empty((len(number), width), np.uint8)
    row.clear()
    for k, r in enumerate(number):
        arcs[k] = np.frombuffer(r.to_bytes(width, "little"), np.uint8)
    return arcs, state, np.array(place, np.int32), made, 0


class Automaton(Pieces):
    """Compiled from a vocabulary and its merges."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names, vocab = byte_names(), spec["model"]["vocab"]
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        label: list[bytes] = [b""] * size
        for t, i in vocab.items():
            label[i] = bytes(names[c] for c in t)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t, i in self.special.items():
            label[i] = t.encode()
        pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.arcs, self.state, self.place, made, self.start = compile_merges(size, merges)
        self.label, self.labels = label, pa.array(label, pa.large_binary())
        self.decimals = pa.array([f"{i}," for i in range(size)], pa.large_string())
        self.length = np.array([len(x) for x in label], np.int64)
        self._trie([(label[i], i) for i in vocab.values() if made[i]])
        marks = "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.specials = regex.compile(f"({marks})") if marks else None

    def _trie(self, tokens: list[tuple[bytes, int]]) -> None:
        """``child[row, byte]``: the next node, or 0, where no word goes on. Nodes that go on have a row of their own, others row 0; the root is ``ROOT``."""
        child: list[dict[int, int]] = [{}, {}]
        ends = [-1, -1]
        for word, i in tokens:
            at = ROOT
            for b in word:
                to = child[at].get(b)
                if to is None:
                    to = child[at][b] = len(child)
                    child.append({})
                    ends.append(-1)
                at = to
            ends[at] = i
        inner = [n for n, c in enumerate(child) if c]
        self.child, self.row = np.zeros((len(inner) + 1, 256), np.int32), np.zeros(len(child), np.int32)
        for k, n in enumerate(inner, 1):
            self.row[n] = k
            self.child[k, list(child[n])] = list(child[n].values())
        self.ends = np.array(ends, np.int32)

    def allowed(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether each token has an arc from each state."""
        at = self.place[token]
        return (self.arcs[state, at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    def paths(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, how many each has): the accepted path that spells each word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")  # longest first, so the words with a byte ``i`` come first
        sizes = sizes[order]
        data = np.frombuffer(b"".join([words[i] for i in order]), np.uint8)
        stops = np.cumsum(sizes)
        starts = stops - sizes
        last = np.full(len(data), -1, np.int32)  # the token that ends at each byte
        for i in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -i, "left"))
            pos, stop = starts[:live] + i, stops[:live]
            before = np.full(live, self.start, np.int32) if i == 0 else self.state[last[pos - 1]]
            node = np.full(live, ROOT, np.int32)
            while len(pos):
                node = self.child[self.row[node], data[pos]]
                token = self.ends[node]
                some = np.flatnonzero(token >= 0)
                some = some[self.allowed(before[some], token[some])]
                last[pos[some]] = token[some]
                on = np.flatnonzero((self.row[node] > 0) & (pos + 1 < stop))
                node, pos, stop, before = node[on], pos[on] + 1, stop[on], before[on]
        steps, at, who = [], stops - 1, np.arange(len(words))
        while len(who):
            token = last[at]
            steps.append((who, token))
            at = at - self.length[token]
            on = np.flatnonzero(at >= starts[who])
            at, who = at[on], who[on]
        counts = np.zeros(len(words), np.int64)
        for who, _ in steps:
            counts[who] += 1
        own = np.empty(len(words), np.int64)
        own[order] = counts
        base = (np.cumsum(own) - own)[order]
        ids = np.empty(int(own.sum()), np.uint32)
        for k, (who, token) in enumerate(steps, 1):
            ids[base[who] + counts[who] - k] = token
        return ids, own

    def path(self, word: bytes) -> list[int]:
        """The same for one word, byte by byte; for long ones."""
        last, data, n = np.full(len(word), -1, np.int32), word, len(word)
        for i in range(n):
            arcs, node = self.arcs[self.start if i == 0 else self.state[last[i - 1]]], ROOT
            for j in range(i, n):
                node = int(self.child[self.row[node], data[j]])
                token = int(self.ends[node])
                if token >= 0:
                    place = int(self.place[token])
                    if arcs[place >> 3] >> (place & 7) & 1:
                        last[j] = token
                if not self.row[node]:
                    break
        out, at = [], n - 1
        while at >= 0:
            out.append(int(last[at]))
            at -= len(self.label[out[-1]])
        return out[::-1]

    def fresh(self, pieces: list[str]) -> list[bytes]:
        words = [self.split(p) for p in pieces]
        every = {w for ws in words for w in ws if w not in self.special}
        spelled = {w: w.encode("utf-8") for w in every}
        short = [w for w, x in spelled.items() if len(x) <= LONG_WORD]
        flat, own = self.paths([spelled[w] for w in short])
        data, ends = flat.tobytes(), np.cumsum(4 * own).tolist()
        path = {w: data[a:b] for w, a, b in zip(short, [0, *ends], ends, strict=False)}
        path |= {w: np.array(self.path(x), np.uint32).tobytes() for w, x in spelled.items() if len(x) > LONG_WORD}
        path |= {w: np.array([i], np.uint32).tobytes() for w, i in self.special.items()}
        return [b"".join([path[w] for w in ws]) for ws in words]

    def split(self, text: str) -> list[str]:
        """The pre-split words of a text, special tokens among them."""
        if self.specials is None or "<" not in text:
            return SPLIT.findall(text)
        return [w for part in self.specials.split(text) for w in ([part] if part in self.special else SPLIT.findall(part))]

    def encode(self, text: str) -> list[int]:
        """The ids of one text."""
        index, _, pieces = cut(pa.array([text], pa.large_string()), False)
        found = self.ids(pieces)
        return np.frombuffer(b"".join([found[i] for i in index]), np.uint32).tolist()

    def decode(self, ids) -> str:
        """Arc labels in order, read as UTF-8."""
        return b"".join(map(self.label.__getitem__, ids)).decode("utf-8", "replace")


_compiled: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    """One automaton a worker process."""
    if path not in _compiled:
        _compiled[path] = Automaton(path)
    return _compiled[path]


def joined(table: pa.Array, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One entry a piece: the entries of ``table`` for its ids, one after another."""
    data, at = taken(table, ids)
    offsets = np.append(at[np.cumsum(counts) - counts], at[-1])
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded digests) for every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(path)
        for batch in batches:
            for first, texts in groups(batch.column(1)):
                index, offsets, pieces = cut(texts, False)
                found = a.ids(pieces)
                counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
                ids = np.frombuffer(b"".join(found), np.uint32)
                before = np.concatenate([[0], np.cumsum(counts[index])])[offsets]
                names, name_at = taken(joined(a.decimals, ids, counts), index)
                spelled, label_at = taken(joined(a.labels, ids, counts), index)  # decoding: the labels of the path's arcs
                name_at, label_at = name_at[offsets].tolist(), label_at[offsets].tolist()
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n),
                        pa.array(np.diff(before), pa.int64()),
                        pa.array([hashlib.sha256(names[name_at[k] : max(name_at[k], name_at[k + 1] - 1)]).hexdigest() for k in range(n)]),
                        pa.array([hashlib.sha256(str(spelled[label_at[k] : label_at[k + 1]], "utf-8", "replace").encode()).hexdigest() for k in range(n)]),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path(TOKENIZER))
