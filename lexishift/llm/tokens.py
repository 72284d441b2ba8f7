"""Whole texts as pieces: cut in Arrow, looked up once a distinct piece, encoded by the tokenizers library where unknown.

Texts are cut only where the tokenizer itself always cuts: before a single blank or line break (byte-level), or at blanks that
the pre-tokenizer drops (word-level). A byte-level text with three blanks on end, two at its end or before a special token's ``<``, or a zero byte is one piece,
since there a cut could part what the tokenizer keeps together. A group of texts is split and its pieces are numbered by
Arrow; only the distinct ones meet Python. What is known of a piece is kept; the table is emptied when it reaches
``KNOWN`` entries and holds no long pieces, so a task's memory is bounded by its texts.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KNOWN, LONG_PIECE, GROUP_BYTES = 1_000_000, 64, 8 << 20
# Fixed value: white space, as RE2 writes it; each text that matches is one piece.
_SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
_WHOLE = rf"{_SPACE}{{3}}|{_SPACE}{_SPACE}(?:\z|<)|\x00"


def vocabulary_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def groups(texts: pa.Array, limit: int = GROUP_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) of ``texts``, nulls made empty, in slices of about ``limit`` bytes and one row at least."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + limit, "right")))
        yield at, texts.slice(at, end - at)
        at = end


def cut(texts: pa.Array, blanks_dropped: bool) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(number of each piece, where each text's pieces start and end, the distinct pieces) of non-null ``texts``."""
    if blanks_dropped:
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    else:
        whole = pc.match_substring_regex(texts, _WHOLE)
        marked = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n")
        if pc.any(whole).as_py():
            apart = pc.indices_nonzero(pc.invert(whole))
            kept = pc.indices_nonzero(whole)
            alone = pa.LargeListArray.from_arrays(np.arange(len(kept) + 1), texts.take(kept))
            split = pc.split_pattern(marked.take(apart), "\0").cast(pa.large_list(pa.large_string()))
            order = np.argsort(np.concatenate([apart.to_numpy(), kept.to_numpy()]))
            lists = pa.concat_arrays([split, alone]).take(pa.array(order))
        else:
            lists = pc.split_pattern(marked, "\0")
    offsets = lists.offsets.to_numpy()
    coded = lists.flatten().dictionary_encode()
    return coded.indices.to_numpy(), offsets - offsets[0], coded.dictionary.to_numpy(zero_copy_only=False).tolist()


class Pieces:
    """Ids of pieces as unsigned 32-bit bytes in the machine's order, which is little-endian wherever Spark runs."""

    def __init__(self):
        self.known: dict[str, bytes] = {}

    def fresh(self, pieces: list[str]) -> list[bytes]:
        raise NotImplementedError

    def ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of each of ``pieces``."""
        known = self.known
        found = list(map(known.get, pieces))
        unknown = [i for i, x in enumerate(found) if x is None]
        if unknown:
            if len(known) + len(unknown) > KNOWN:
                known.clear()
            for at in range(0, len(unknown), 20_000):
                part = unknown[at : at + 20_000]
                for i, x in zip(part, self.fresh([pieces[i] for i in part]), strict=True):
                    found[i] = x
                    if len(pieces[i]) <= LONG_PIECE:
                        known[pieces[i]] = x
        return found


class Encoder(Pieces):
    """The tokenizers library over a vocabulary file."""

    def __init__(self, path: str, blanks_dropped: bool):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation(), self.library.no_padding()
        self.blanks_dropped = blanks_dropped

    def fresh(self, pieces: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> Iterator[memoryview]:
        """The ids of each of ``texts`` (nulls are empty), in order."""
        for _, group in groups(texts):
            index, offsets, pieces = cut(group, self.blanks_dropped)
            data, at = taken(pa.array(self.ids(pieces), pa.large_binary()), index)
            ends = at[offsets].tolist()
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                yield data[a:b]


def taken(values: pa.Array, index: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The bytes of ``values`` at ``index`` one after another, and where each starts (and the last ends)."""
    out = values.take(pa.array(index))
    offsets = np.frombuffer(out.buffers()[1], np.int64, len(out) + 1, 8 * out.offset)
    return memoryview(out.buffers()[2] or b""), offsets


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, blanks_dropped: bool) -> Encoder:
    """One encoder a worker process, kept between tasks."""
    if (path, blanks_dropped) not in _encoders:
        _encoders[path, blanks_dropped] = Encoder(path, blanks_dropped)
    return _encoders[path, blanks_dropped]
