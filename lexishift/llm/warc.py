"""A deterministic sharded WARC writer and its reader.

Records are sorted by (``page_id``, payload digest, url) and cut into parts at bounds that follow from the data alone: exact counts
in ``FINE`` even ranges of ids, whose crowded ones are cut again, by id or, where one id crowds them, by digest. No sampling
is involved, so the same rows give the same archives, byte for byte, however they are partitioned and whichever
task runs twice. A task writes one gzip member a record, rolls to a new file at the end of a part or when the compressed
size passes ``roll_bytes``, and returns a manifest row a file under a temporary name; a second job renames what the manifest
names. Headers (dates, ids, lengths, digests) are made anew from the record alone. Of records with one payload the
smallest ``page_id`` is the response and the others are revisits, which carry headers only.

Which record is a revisit follows from digests: those are grouped before the shuffle, so a payload that a third of
all pages share is one row a task, and only ids of revisits travel to the writer beside the pages.

Defined results: a null payload is empty; payloads under ``min_revisit_bytes`` are always responses; rows that share
both the smallest ``page_id`` and the payload are all responses; a null ``page_id`` sorts first and is a response; null
urls are written as empty; repeated rows differ in their record id, which counts them; an empty table writes no file and
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexishift.llm.storage import delete, materialise, task_fs, workspace
from lexishift.llm.wavelet import commit

ROLL_BYTES, LEVEL, DATE = 64 << 20, 3, "1970-01-01T00:00:00Z"
#: Even ranges of ids that are counted; bytes of payload a part holds about, and the least number of parts.
FINE, PART_BYTES, LEAST_PARTS = 4096, 256 << 20, 64
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "part int, seq int, temporary string, name string, n_records long, n_bytes long"
SCHEMA = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("temporary", pa.string()), ("name", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url: str, payload: bytes, refers_to, copy: int = 0) -> bytes:
    """One WARC/1.1 record, compressed as one gzip member; ``copy`` counts equal records before it."""
    digest = base32_sha1(payload)
    http = HTTP % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id} {digest} {copy} {url}')}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}", f"WARC-Page-ID: {'' if page_id is None else page_id}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    out = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return out.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + out.flush()


def members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file one after another; one member and one buffer are held at a time."""
    data, unzip, parts = b"", None, []
    while True:
        if not data:
            data = stream.read(size)
            if not data:
                if unzip is not None:
                    raise ValueError("an archive is cut short")
                return
        unzip = unzip or zlib.decompressobj(31)
        parts.append(unzip.decompress(data))
        data = unzip.unused_data
        if unzip.eof:
            yield b"".join(parts)
            unzip, parts = None, []


def parse(raw: bytes) -> dict:
    """Fields of a record; digests of the block, and of a response's payload, are computed anew and must agree."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if not lines[0].startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError("a record is damaged")
    http, _, payload = block.partition(b"\r\n\r\n")
    told = int(http.rpartition(b"Content-Length: ")[2])
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != told or base32_sha1(payload) != digest):
        raise ValueError("a payload is damaged")
    number = lambda x: int(x) if x else None
    return {
        "page_id": number(fields["WARC-Page-ID"]), "payload_bytes": told, "payload_digest": digest, "record_type": fields["WARC-Type"],
        "refers_to": number(fields.get("WARC-Refers-To-Page-ID", "")), "url": fields["WARC-Target-URI"],
    }


def parts_of(keyed: DataFrame) -> tuple[DataFrame, int, int]:
    """(fine, first, k, low, width, by_digest), a row for each of at most ``FINE`` + 1 ranges of ids that hold rows of
    ``keyed`` (page_id, digest, size): its rows go to parts ``first`` to ``first`` + k - 1, by id in steps of ``width`` from
    ``low``, or by digest.
    """
    spark = keyed.sparkSession
    low, high, size = keyed.agg(F.min("page_id"), F.max("page_id"), F.sum("size")).first()
    low, high, size = low or 0, high or 0, size or 0
    step, aim = (high - low) // FINE + 1, max(1, size // max(LEAST_PARTS, size // PART_BYTES))
    ranges = keyed.withColumn("fine", fine_of(low, step)).groupBy("fine").agg(F.sum("size"), F.min("page_id"), F.max("page_id")).orderBy("fine").collect()  # FINE + 1 rows at most
    rows, first, held = [], 0, 0
    for fine, own, a, b in ranges:
        k = -(-own // aim)
        if k > 1 or held + own > aim:  # a crowded range has parts of its own
            first, held = first + (held > 0), 0
        if k > 1:
            rows.append((fine, first, k, a or 0, ((b or 0) - (a or 0)) // k + 1, a == b))
            first += k
        else:
            rows.append((fine, first, 1, a or 0, 1, False))
            held += own
    return spark.createDataFrame(rows, "fine int, first int, k int, low long, width long, by_digest boolean"), low, step


def fine_of(low: int, step: int):
    """The range of an id: -1 for null, else from 0 to ``FINE`` - 1."""
    return F.coalesce(F.floor((F.col("page_id").cast("decimal(20,0)") - F.lit(low)) / F.lit(step)).cast("int"), F.lit(-1))


def write_warc(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, min_revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``folder``; the committed manifest."""
    spark, run = pages.sparkSession, uuid.uuid4().hex
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", "").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    keyed = materialise(rows.select("page_id", "digest", F.octet_length("html").cast("long").alias("size")), f"{folder}/digests")
    plan, low, step = parts_of(keyed)
    told = keyed.filter((F.col("size") >= min_revisit_bytes) & F.col("page_id").isNotNull())
    first = told.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    revisits = told.join(first, "digest").filter("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()
    both = rows.select("page_id", "digest", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("refers_to"))
    marks = revisits.select("page_id", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "refers_to")
    # pages and marks of one (page_id, digest) fall into one part, marks first: no join moves the payloads
    inner = F.when(F.col("by_digest"), F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * F.col("k") / F.lit(1 << 32))).otherwise(F.floor((F.col("page_id") - F.col("low")) / F.col("width")))
    placed = both.unionByName(marks).withColumn("fine", fine_of(low, step)).join(F.broadcast(plan), "fine")  # FINE + 1 rows at most
    placed = placed.select((F.col("first") + F.when(F.col("k") > 1, F.least(F.coalesce(inner, F.lit(0)), F.col("k") - 1)).otherwise(0)).cast("int").alias("part"), *both.columns)
    ordered = placed.repartition("part").sortWithinPartitions("part", "page_id", "digest", "kind", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = task_fs(folder)
        fs.create_dir(f"{base}/_temporary_{run}", recursive=True)
        part, seq, out, temporary, n, size = -1, 0, None, "", 0, 0
        mark, target, last, copy = None, None, None, 0

        def close() -> pa.RecordBatch:
            out.close()
            row = {"part": part, "seq": seq, "temporary": temporary, "name": f"pages-{part:06d}-{seq:06d}.warc.gz", "n_records": n, "n_bytes": size}
            return pa.RecordBatch.from_pylist([row], schema=SCHEMA)

        for batch in batches:
            for own, page_id, digest, kind, url, html, refers_to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if kind == 0:
                    mark, target = (page_id, digest), refers_to
                    continue
                if own != part:
                    if out is not None:
                        yield close()
                    part, seq, out = own, 0, None
                payload = html.encode("utf-8", "surrogatepass")
                copy = copy + 1 if last == (page_id, digest, url) else 0
                last = (page_id, digest, url)
                if out is None:
                    temporary = f"_temporary_{run}/{uuid.uuid4().hex}"
                    out, n, size = fs.open_output_stream(f"{base}/{temporary}", compression=None), 0, 0
                data = record(page_id, url, payload, target if mark == (page_id, digest) else None, copy)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= roll_bytes:
                    yield close()
                    out, seq = None, seq + 1
        if out is not None:
            yield close()

    manifest = materialise(ordered.mapInArrow(write, MANIFEST), f"{folder}/manifest")
    commit(manifest, folder)
    delete(spark, f"{folder}/_temporary_{run}")
    delete(spark, f"{folder}/digests")
    return manifest


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """One row a record of the archives that the manifest names."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = task_fs(folder)
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held = []
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for raw in members(f):
                        held.append(parse(raw))
                        if len(held) == 5000:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held = []
                yield pa.RecordBatch.from_pylist(held, schema=schema)

    width = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("name").repartition(width).mapInArrow(read, READ)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = workspace(spark, "warc")
    manifest = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), folder)
    return read_warc(manifest, folder).drop("url")
