"""Token ids in one wavelet matrix a shard: bit-planes with rank and select, read back or searched from the file.

Documents are range-partitioned by id and sorted, so shards follow each other in ascending order. Each task encodes
its documents, rolls a shard at ``SHARD_TOKENS`` ids, writes it under a temporary name and returns a manifest row;
a second job renames the files that the manifest names (again and again without harm), so files of lost
attempts never count. Where a document starts is its place in the shard plus the sum of all earlier shards.

Defined results: a null text is empty (its one id is the end id); a null ``doc_id`` sorts first; rows with one
``doc_id`` follow each other in any order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexishift.llm.storage import delete, materialise, task_fs, workspace
from lexishift.llm.tokens import encoder, vocabulary_path

MAGIC, BLOCK, SHARD_TOKENS, END = b"WVMX0001", 512, 2_000_000, 0
TOKENIZER = "byte_bpe_50k.json"


class WaveletMatrix:
    """Planes from the highest bit down; each holds the sequence's bit in the order that the planes above have made."""

    def __init__(self, length: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray]):
        self.length, self.planes, self.zeros, self.ranks = length, planes, zeros, ranks

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        if len(ids) and int(ids.max()) >> bits:
            raise ValueError(f"id {int(ids.max())} does not fit {bits} bits")
        planes, zeros, ranks, row = [], [], [], ids.astype(np.uint16 if bits <= 16 else np.uint32)
        for level in range(bits - 1, -1, -1):
            one = (row >> level & 1).astype(bool)
            planes.append(np.packbits(one))
            ranks.append(cls._directory(planes[-1]))
            low = row[~one]
            zeros.append(len(low))
            row = np.concatenate([low, row[one]])
        return cls(len(ids), planes, zeros, ranks)

    @staticmethod
    def _directory(plane: np.ndarray) -> np.ndarray:
        """Ones before each block of ``BLOCK`` bits."""
        step = BLOCK // 8
        padded = np.zeros(-(-max(1, len(plane)) // step) * step, np.uint8)
        padded[: len(plane)] = plane
        per = np.bitwise_count(padded.reshape(-1, step)).sum(1, dtype=np.uint32)
        return np.concatenate([[0], np.cumsum(per)]).astype(np.uint32)

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block, n = i // BLOCK, int(self.ranks[level][i // BLOCK])
        part = self.planes[level][block * BLOCK // 8 : (i + 7) // 8]
        n += int(np.bitwise_count(part).sum())
        return n - (int(part[-1] & ((1 << (8 - i % 8)) - 1)).bit_count() if i % 8 and len(part) else 0)

    def access(self, i: int) -> int:
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit = int(self.planes[level][i // 8]) >> (7 - i % 8) & 1
            ones = self._ones(level, i)
            i, value = (zeros + ones, value << 1 | 1) if bit else (i - ones, value << 1)
        return value

    def _range(self, symbol: int, i: int) -> tuple[int, int]:
        low, high, bits = 0, i, len(self.planes)
        for level, zeros in enumerate(self.zeros):
            a, b = self._ones(level, low), self._ones(level, high)
            low, high = (zeros + a, zeros + b) if symbol >> (bits - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences of ``symbol`` before place ``i``."""
        low, high = self._range(symbol, i)
        return high - low

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.length)

    def select(self, symbol: int, k: int) -> int:
        """Place of occurrence ``k`` (from 0) of ``symbol``; -1 if there are fewer."""
        if k >= self.count(symbol):
            return -1
        low, high = 0, self.length  # least i with rank(i) > k
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (low, mid) if self.rank(symbol, mid) > k else (mid, high)
        return low

    def ids(self) -> np.ndarray:
        """The whole sequence, plane by plane from the lowest."""
        row = np.zeros(self.length, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level in range(len(self.planes) - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.length).view(bool)
            above = np.empty_like(row)
            above[~one] = row[: self.zeros[level]]
            above[one] = row[self.zeros[level] :] | row.dtype.type(1 << (len(self.planes) - 1 - level))
            row = above
        return row


def write_shard(ids: np.ndarray, doc_ids: list, lengths: np.ndarray, bits: int) -> bytes:
    """Magic, header length, header (JSON: counts, bits, zeros, section sizes), then documents, planes and rank directories."""
    m = WaveletMatrix.build(ids, bits)
    parts = [zlib.compress(json.dumps(doc_ids).encode(), 1), zlib.compress(lengths.astype("<u4").tobytes(), 1)]
    parts += [p.tobytes() for p in m.planes] + [r.astype("<u4").tobytes() for r in m.ranks]
    head = json.dumps({"n": m.length, "bits": bits, "zeros": m.zeros, "sizes": [len(p) for p in parts]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *parts])


def read_shard(data: bytes) -> tuple[WaveletMatrix, list, np.ndarray]:
    """(matrix, document ids, document lengths) of a shard's bytes."""
    if data[:8] != MAGIC:
        raise ValueError("not a wavelet shard")
    size = struct.unpack("<I", data[8:12])[0]
    head, at, parts = json.loads(data[12 : 12 + size]), 12 + size, []
    for n in head["sizes"]:
        parts.append(data[at : at + n])
        at += n
    if at != len(data):
        raise ValueError("a shard is cut short")
    planes = [np.frombuffer(p, np.uint8) for p in parts[2 : 2 + head["bits"]]]
    ranks = [np.frombuffer(p, "<u4") for p in parts[2 + head["bits"] :]]
    return WaveletMatrix(head["n"], planes, head["zeros"], ranks), json.loads(zlib.decompress(parts[0])), np.frombuffer(zlib.decompress(parts[1]), "<u4")


MANIFEST = "part int, seq int, temporary string, name string, n_docs long, n_tokens long"


def bits_of(path: str) -> int:
    """Planes that the ids of a vocabulary file need."""
    return max(1, (encoder(path, False).library.get_vocab_size(with_added_tokens=True) - 1).bit_length())


def write_token_shards(docs: DataFrame, folder: str, path: str, end: int = END, bits: int | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write ``docs`` (doc_id, text) as shards below ``folder``; the committed manifest. ``bits`` follow from the vocabulary where they are not given; an id that does not fit is an error."""
    spark, run = docs.sparkSession, uuid.uuid4().hex
    bits = max(bits_of(path), int(end).bit_length()) if bits is None else bits

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = encoder(path, False), np.array([end], "<u4").tobytes()
        fs, base = task_fs(folder)
        fs.create_dir(f"{base}/_temporary_{run}", recursive=True)
        part, seq, held, ids, lengths, n = TaskContext.get().partitionId(), 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, held, ids, lengths, n
            name, temporary = f"shard-{part:06d}-{seq:06d}.wm", f"_temporary_{run}/{uuid.uuid4().hex}"
            with fs.open_output_stream(f"{base}/{temporary}") as out:
                out.write(write_shard(np.frombuffer(b"".join(ids), "<u4"), held, np.array(lengths, np.int64), bits))
            row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "temporary": temporary, "name": name, "n_docs": len(held), "n_tokens": n}], schema=SCHEMA)
            seq, held, ids, lengths, n = seq + 1, [], [], [], 0
            return row

        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1)), strict=True):
                held.append(doc_id), ids.append(bytes(data)), ids.append(tail), lengths.append(len(data) // 4 + 1)
                n += lengths[-1]
                if n >= shard_tokens:
                    yield flush()
        if held:
            yield flush()

    SCHEMA = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("temporary", pa.string()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
    # rows that share one id are parted by their texts' hash, so none of them need lie in one task
    ordered = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    manifest = materialise(ordered.mapInArrow(write, MANIFEST), f"{folder}/manifest")
    commit(manifest, folder)
    delete(spark, f"{folder}/_temporary_{run}")
    return manifest


def commit(manifest: DataFrame, folder: str) -> None:
    """Give each file of the manifest its final name; a repeated rename finds it done."""

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = task_fs(folder)
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if fs.get_file_info(f"{base}/{a}").is_file:
                    fs.move(f"{base}/{a}", f"{base}/{b}")
                elif not fs.get_file_info(f"{base}/{b}").is_file:
                    raise OSError(f"neither {a} nor {b} is there")
            yield batch.select([1])

    manifest.select("temporary", "name").mapInArrow(rename, "name string").write.format("noop").mode("overwrite").save()


def read_token_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the shards' files. Only the manifest, a row a file, is ordered in one place."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = task_fs(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{root}/{name}") as f:
                    matrix, doc_ids, lengths = read_shard(f.read())
                ids, ends = memoryview(matrix.ids().astype("<u4")).cast("B"), np.cumsum(lengths, dtype=np.int64)
                crc = [zlib.crc32(ids[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(base + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    return _placed(manifest).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _placed(manifest: DataFrame) -> DataFrame:
    """(name, base, n_tokens) of each shard: how many ids stand before it."""
    before = F.sum("n_tokens").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))
    width = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("name", F.coalesce(before, F.lit(0)).cast("long").alias("base"), "n_tokens").repartition(width)


def search_token_shards(manifest: DataFrame, folder: str, symbols: list[int]) -> DataFrame:
    """(name, symbol, n, first, last): of each shard that holds one of ``symbols``, how often and at which places of all ids it first and last stands, by rank and select on its file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = task_fs(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{root}/{name}") as f:
                    matrix, _, _ = read_shard(f.read())
                rows = [(s, matrix.count(s)) for s in symbols if s >> len(matrix.planes) == 0]
                rows = [(name, s, n, base + matrix.select(s, 0), base + matrix.select(s, n - 1)) for s, n in rows if n]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string() if k == 0 else pa.int64()) for k in range(5)], names=["name", "symbol", "n", "first", "last"])

    return _placed(manifest).mapInArrow(read, "name string, symbol long, n long, first long, last long")


def token_at(manifest: DataFrame, folder: str, places: list[int]) -> DataFrame:
    """(place, token) for those of ``places`` (from 0, over all ids) that there are, by access to the one shard that holds each."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = task_fs(folder)
        for batch in batches:
            for name, base, n in zip(*[c.to_pylist() for c in batch.columns[:3]], strict=True):
                own = [p for p in places if base <= p < base + n]
                if own:
                    with fs.open_input_stream(f"{root}/{name}") as f:
                        matrix, _, _ = read_shard(f.read())
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([matrix.access(p - base) for p in own], pa.int64())], names=["place", "token"])

    return _placed(manifest).mapInArrow(read, "place long, token long")


def op4_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = workspace(spark, "wavelet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_token_shards(write_token_shards(docs, folder, vocabulary_path(TOKENIZER)), folder)
