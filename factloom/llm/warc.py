"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writer: pages are grouped into archives of about ARCHIVE_BYTES of payload. Each archive begins with
a skippable frame (magic 0x184D2A5D) that holds the shared dictionary, then one frame per record.
Records of equal payload (at least MIN_REVISIT bytes) are a response and revisits of it: digests are
counted first, so only digests that do repeat are joined back, by a join that adaptive execution can
split. Archives are rows (archive, content) of a table in the shared folder, which Spark's committer
makes safe against lost executors; `export_archives` copies them out as files and `read_archives`
takes files from any such folder.

Reader: loads the dictionary from the leading frame, decodes frame by frame, and checks the version
line, header lines, record and block lengths and payload digests; a record that fails raises. It
reads forward in pieces, so `read_files` takes archives of any size and holds one record at a time.

Defined results: a null html is an empty payload; rows that repeat a page_id with one payload are
responses alike if theirs is the smallest id; null page_ids rank last; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, saved, small_batches, table

MAGIC = 0x184D2A5D
MIN_REVISIT = 100
ARCHIVE_BYTES = 8 << 20
#: The dictionary is trained on so many payloads (first by hash of their digest), each cut to so many bytes.
SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 16_384, 65_536
LEVEL = 3
#: Bytes that the reader takes from an archive at a time, and feeds to a new frame first.
PIECE, FIRST_PIECE = 1 << 20, 2048

RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def header(fields: list[tuple[str, str]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in fields).encode()


def urn(page_id: int | None) -> str:
    return "urn:page:" + ("none" if page_id is None else str(page_id))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """The bytes of one WARC record; a revisit carries the headers of its payload alone."""
    http = b"HTTP/1.1 200 OK\r\n" + header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]) + b"\r\n"
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{urn(page_id)}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", "".join((url or "urn:none").split())),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        fields[5:5] = [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<{urn(refers_to)}>"),
        ]
    return b"WARC/1.1\r\n" + header(fields) + b"\r\n" + block + b"\r\n\r\n"


def headers_of(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.decode("utf-8").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"bad header line {line!r}")
        out[name.strip().lower()] = value.strip()
    return out


def page_of(value: str) -> int | None:
    tail = value.removeprefix("<urn:page:").removesuffix(">")
    return None if tail == "none" else int(tail)


def parsed(data: bytes) -> tuple:
    """Check a decoded record and take it apart, in the order of RECORDS."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not gap or not version.startswith(b"WARC/1."):
        raise ValueError("no WARC version line")
    fields = headers_of(lines)
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"block of {len(rest) - 4} bytes where {length} were told")
    http, gap, payload = rest[:length].partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("no HTTP header")
    size = int(headers_of(http.partition(b"\r\n")[2])["content-length"])
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} fails its length or digest")
    if kind == "revisit" and payload:
        raise ValueError("a revisit with a payload")
    refers = page_of(fields["warc-refers-to"]) if kind == "revisit" else None
    return page_of(fields["warc-record-id"]), fields["warc-target-uri"], size, digest, kind, refers, payload


def read_archive(archive: BinaryIO | bytes) -> Iterator[bytes]:
    """Decoded records of an archive, one per frame. Reads forward, and holds one record at a time."""
    archive = io.BytesIO(archive) if isinstance(archive, bytes) else archive
    magic, size = struct.unpack("<II", archive.read(8).ljust(8, b"\0"))
    words = archive.read(size) if magic == MAGIC else b""
    if magic != MAGIC or len(words) < size:
        raise ValueError("no dictionary in a leading skippable frame")
    if words[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary may itself be compressed
        words = zstandard.ZstdDecompressor().decompress(words)
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)) if words else zstandard.ZstdDecompressor()
    held, at = b"", 0
    while True:
        if at == len(held):
            held, at = archive.read(PIECE), 0
            if not held:
                return
        # pieces double in size: what is fed past a frame's end is never much more than the frame
        frame, parts, step = decoder.decompressobj(), [], FIRST_PIECE
        while not frame.eof:
            if at == len(held):
                held, at = archive.read(PIECE), 0
                if not held:
                    raise ValueError("an unfinished frame")
            piece = memoryview(held)[at : at + step]
            parts.append(frame.decompress(piece))
            at += len(piece)
            step = min(2 * step, PIECE)
        at -= len(frame.unused_data)
        yield b"".join(parts)


#: What any record holds, the dictionary where there are no pages to learn one from.
COMMON_BYTES = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http; msgtype=response\r\n<!DOCTYPE html><html><head><title></title></head><body><p></p></body></html>"


def trained(payloads: list[bytes]) -> bytes:
    """A dictionary from sample payloads; the payloads themselves if they are too few to train on."""
    try:
        if len(payloads) >= 8:
            return zstandard.train_dictionary(DICTIONARY_BYTES, payloads).as_bytes()
    except zstandard.ZstdError:
        pass
    return (COMMON_BYTES + b"".join(payloads))[:DICTIONARY_BYTES]


def packed(batches: Iterator[pa.RecordBatch], words: bytes) -> Iterator[pa.RecordBatch]:
    """Write the pages of a task into archives."""
    coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words)) if words else zstandard.ZstdCompressor(level=LEVEL)
    lead = struct.pack("<II", MAGIC, len(words)) + words
    frames, size = [], 0

    def archive() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([uuid.uuid4().hex]), pa.array([lead + b"".join(frames)], pa.binary())], names=["archive", "content"]
        )

    for batch in batches:
        for row in batch.to_pylist():
            payload = (row["html"] or "").encode()
            revisit = row["first"] is not None and row["first"] != row["page_id"]
            frames.append(coder.compress(record(row["page_id"], row["url"], payload, row["digest"], row["first"], revisit)))
            size += len(payload)
            if size >= ARCHIVE_BYTES:
                yield archive()
                frames, size = [], 0
    if frames:
        yield archive()


def records_of(archive: BinaryIO) -> Iterator[pa.RecordBatch]:
    """The parsed records of an archive, in batches of bounded rows and bytes."""
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    rows, held = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for data in read_archive(archive):
        rows.append(parsed(data))
        held += len(data)
        if len(rows) == 1000 or held > BATCH_BYTES:
            yield batch()
            rows, held = [], 0
    if rows:
        yield batch()


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            yield from records_of(io.BytesIO(content.as_py()))


def write_archives(pages: DataFrame) -> DataFrame:
    """Write a record per page; returns the table (archive, content) in the shared folder."""
    spark = pages.sparkSession
    small_batches(spark)
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.sha2(html, 256).alias("digest"))
    long = rows.where(F.octet_length("html") >= MIN_REVISIT)
    again = long.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first")).where("n > 1").drop("n")
    chosen = rows.where("html <> ''").select("digest").orderBy(F.xxhash64("digest"), "digest").limit(SAMPLES).collect()
    sample = rows.where(F.col("digest").isin([r.digest for r in chosen])).groupBy("digest").agg(F.first(F.substring("html", 1, SAMPLE_BYTES)).alias("html"))
    sample = sample.orderBy("digest").collect()
    words = spark.sparkContext.broadcast(trained([r.html.encode()[:SAMPLE_BYTES] for r in sample]))
    joined = rows.join(again, "digest", "left")
    return saved(joined.mapInArrow(lambda it: packed(it, words.value), "archive string, content binary"), "warc")


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of archives given as rows with a binary column `content` (a table, or binaryFile)."""
    return archives.select("content").mapInArrow(unpacked, RECORDS)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archive files below a path, whatever their size: each is opened and read forward by its task."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file:///") else uri)
                with store.open_input_stream(name, compression=None) as archive:
                    yield from records_of(archive)

    small_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", "true").load(path).select("path")
    return files.repartition(spark.sparkContext.defaultParallelism, "path").mapInArrow(opened, RECORDS)


def export_archives(archives: DataFrame, uri: str) -> DataFrame:
    """Write each archive as <uri>/<archive>.warc.zst; any file system pyarrow knows. Returns their names."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = f"{root}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content.as_py())
                store.move(part, f"{root}/{name}.warc.zst")  # whole files only, also after a retry
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["archive"])

    return archives.select("archive", "content").mapInArrow(put, "archive string")


def op3_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = read_archives(write_archives(table(spark, sf_dir, "pages")))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = f"""
with p as (select page_id, coalesce(html, '') h, sha256(coalesce(html, '')) d, strlen(coalesce(html, '')) n from pages),
f as (select page_id, n, d, case when n >= {MIN_REVISIT} then min(page_id) over (partition by d) end first from p)
select page_id, n::bigint payload_bytes, d payload_digest,
  case when first is not null and first <> page_id then 'revisit' else 'response' end record_type,
  case when first <> page_id then first end refers_to
from f
"""
