"""WARC archives compressed record by record with a Zstandard dictionary of their own.

An archive begins with a skippable frame that holds its dictionary, trained from the archive's first
records (where they are too few to train on, their beginnings are the dictionary); every record follows
as a frame of its own, so that a reader can begin at any of them. Of
equal payloads of MIN_REVISIT bytes or more only one is stored, that of the largest page_id; the
others are revisit records that refer to it. Which those are is decided on digests alone; texts move
once, by page, so a payload that a third of the pages share gathers nowhere.

A task writes its archives under names of their own into the shared folder and lists them in a
manifest; readers take listed archives only, so files of lost or repeated attempts don't count.

Defined cases: a null html is an empty payload and a null url is left out; a null page_id is kept,
counts as smaller than any other, and is null again when read; rows that repeat the largest page_id
of a payload are responses all; an empty table gives no archives. Other columns are not archived. A
reader holds one archive at a time, compressed, and about 8 MB of payloads, or one larger.
"""

from __future__ import annotations

import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm.common import materialize, shared_path

MIN_REVISIT = 1000
#: Bytes of records that train a dictionary, of a dictionary, and of an archive before compression.
SAMPLE_BYTES, DICTIONARY_BYTES, ARCHIVE_BYTES = 4 << 20, 64 << 10, 64 << 20
#: Of each record, where the records of an archive are too few to train on.
BEGINNING_BYTES = 512
# fixed values: names of the formats
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def decide(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``: the last is null for responses."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    light = rows.select("page_id", "digest", F.octet_length("payload").alias("size")).where(F.col("size") >= MIN_REVISIT)
    last = light.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & F.col("refers_to").isNotNull())
    # As a table, so that the join shuffles two inputs and a digest that many pages share is split.
    last = materialize(last.select("digest", "refers_to"), "digests")
    revisits = light.join(last, "digest").where(F.col("page_id").isNull() | (F.col("page_id") < F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()
    a, b = rows.alias("a"), revisits.alias("b")
    return a.join(b, F.col("a.page_id").eqNullSafe(F.col("b.page_id")) & (F.col("a.digest") == F.col("b.digest")), "left").select("a.*", "b.refers_to")


def _id(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_id(page)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=~-._')}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_id(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary of the samples: trained, or the beginnings of those that are too few for it."""
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, total // 10)), samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(s[:BEGINNING_BYTES] for s in samples)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def frames(records: Iterator[bytes]) -> Iterator[tuple[bytes, int]]:
    """The bytes of one archive piece by piece, with the number of records in each."""
    first, size = [], 0
    for r in records:
        first.append(r)
        size += len(r)
        if size >= SAMPLE_BYTES:
            break
    words = train(first)
    held = words.as_bytes()
    yield SKIPPABLE.to_bytes(4, "little") + len(held).to_bytes(4, "little") + held, 0
    press = zstandard.ZstdCompressor(level=9, dict_data=words)
    for r in first:
        yield press.compress(r), 1
    for r in records:
        yield press.compress(r), 1


def read_archive(data: memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record."""
    words = None
    if len(data) >= 8 and int.from_bytes(data[:4], "little") == SKIPPABLE:
        n = int.from_bytes(data[4:8], "little")
        words, data = zstandard.ZstdCompressionDict(bytes(data[8 : 8 + n])), data[8 + n :]
    opener = zstandard.ZstdDecompressor(dict_data=words) if words is not None else zstandard.ZstdDecompressor()
    with io.BufferedReader(opener.stream_reader(io.BytesIO(data), read_across_frames=True), 1 << 20) as f:
        while line := f.readline():
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no record begins with {line[:40]!r}")
            head = {}
            while (line := f.readline().rstrip(b"\r\n")):
                name, _, value = line.partition(b":")
                head[name.decode().lower()] = value.strip().decode()
            block = f.read(int(head["content-length"]))
            if f.read(4) != b"\r\n\r\n":
                raise ValueError("a record's end is missing")
            yield head, block


def write_archives(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages; the manifest of archives: ``path``, ``records``, ``bytes``, read from a table."""
    folder = shared_path(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        pages_left = (row for b in batches for row in zip(*(b.column(k) for k in range(5)), strict=True))
        made = (record(p.as_py(), u.as_py(), h.as_py(), d.as_py(), r.as_py(), date) for p, u, h, d, r in pages_left)
        ahead = next(made, None)
        while ahead is not None:

            def some(size: int = 0) -> Iterator[bytes]:
                nonlocal ahead
                while ahead is not None and size < archive_bytes:
                    size += len(ahead)
                    now, ahead = ahead, next(made, None)
                    yield now

            name, n, size = f"{uuid.uuid4().hex}.warc.zst", 0, 0
            with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
                for piece, count in frames(some()):
                    f.write(piece)
                    n, size = n + count, size + len(piece)
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [n], "bytes": [size]})

    return materialize(decide(pages).mapInArrow(write, "path string, records long, bytes long"), "manifest")


def read_archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """One row per record of the listed archives; stored payloads are held against their digests."""
    folders = [r.folder for r in manifest.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).distinct().collect()]
    if not folders:
        return spark.createDataFrame([], _RECORD)
    files = spark.read.format("binaryFile").load(folders).withColumn("name", F.element_at(F.split("path", "/"), -1))
    listed = manifest.select(F.element_at(F.split("path", "/"), -1).alias("name"))

    def page(urn: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
        return int(found[1]) if found else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                for head, block in read_archive(memoryview(batch.column(0)[i].as_buffer())):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                    length = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
                    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"the payload of {head['warc-record-id']} is not what was archived")
                    url = head.get("warc-target-uri")
                    out.append((page(head["warc-record-id"]), None if url is None else unquote(url), kind, page(head.get("warc-refers-to")), digest, length, payload if kind == "response" else None))
                    size += len(payload)
                    if size > 8 << 20:
                        yield _table(out)
                        out, size = [], 0
        if out:
            yield _table(out)

    return files.join(listed, "name", "left_semi").select("content").mapInArrow(read, _RECORD)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], schema=pa.schema(kinds))
