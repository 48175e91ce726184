"""WARC archives, each record a Zstandard frame.

Method of the reader: the dictionary comes from the leading skippable frame, one
frame is decoded for each record, headers and lengths are validated.

An archive is a row (path, content), as Spark's ``binaryFile`` source gives files,
so the reader takes archives from any store that Spark reads.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecmill.llm.common import shared_table, table

#: Fixed by the formats: magic numbers (little-endian) and the profile of revisits.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: An archive is closed when its frames reach this size, so that a row stays small.
ARCHIVE_BYTES = 2 << 20
#: Records (their bytes) from which an archive's dictionary is trained, and its size.
DICTIONARY_SAMPLE_BYTES = 512 << 10
DICTIONARY_BYTES = 16 << 10
MIN_REVISIT_BYTES = 100
MAX_RECORD_BYTES = 1 << 30
DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive that breaks the format."""


def _header(fields: list[tuple[str, str]]) -> bytes:
    clean = [f"{k}: {' '.join(v.split())}" for k, v in fields]
    return VERSION + b"\r\n" + "\r\n".join(clean).encode() + b"\r\n\r\n"


def build_record(record_id: str, uri: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record. A revisit holds the HTTP header only; its lengths and digest are the full payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", uri),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
    ]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    return _header([*fields, ("Content-Length", str(len(block)))]) + block + b"\r\n\r\n"


def _dictionary(sample: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    if sum(map(len, sample)) < 4096:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample)
    except zstandard.ZstdError:  # too few or too equal samples
        return zstandard.ZstdCompressionDict(b"".join(sample)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class ArchiveWriter:
    """Collects records into archives of about ``ARCHIVE_BYTES``; the dictionary is made from the first records."""

    def __init__(self):
        self._waiting: list[bytes] = []
        self._parts: list[bytes] | None = None
        self._size = 0

    def add(self, record: bytes) -> bytes | None:
        """An archive, if this record completes one."""
        if self._parts is None:
            self._waiting.append(record)
            self._size += len(record)
            return None if self._size < DICTIONARY_SAMPLE_BYTES else self._start() or None
        self._write(record)
        return self.close() if self._size >= ARCHIVE_BYTES else None

    def _start(self) -> bytes:
        waiting, self._waiting, self._size = self._waiting, [], 0
        made = _dictionary(waiting)
        self._parts = []
        if made is not None:
            raw = made.as_bytes()
            self._parts.append(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
        self._packer = zstandard.ZstdCompressor(level=3, dict_data=made, write_checksum=True)
        for record in waiting:
            self._write(record)
        return self.close() if self._size >= ARCHIVE_BYTES else b""

    def _write(self, record: bytes) -> None:
        frame = self._packer.compress(record)
        self._parts.append(frame)
        self._size += len(frame)

    def close(self) -> bytes | None:
        if self._waiting:
            if done := self._start():
                return done
        if not self._parts or self._size == 0:
            return None
        content, self._parts, self._size = b"".join(self._parts), None, 0
        return content


def read_dictionary(content: bytes) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary of the leading skippable frame (plain, or itself a frame), and where records begin."""
    if len(content) < 8 or struct.unpack_from("<I", content)[0] != DICTIONARY_MAGIC:
        return None, 0
    end = 8 + struct.unpack_from("<I", content, 4)[0]
    if end > len(content):
        raise WarcError("the dictionary's frame is cut off")
    raw = content[8:end]
    if raw[:4] == struct.pack("<I", FRAME_MAGIC):
        raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 27)
    return zstandard.ZstdCompressionDict(raw), end


def read_frames(content: bytes) -> Iterator[bytes]:
    """Each record's bytes: one frame each; other skippable frames are passed over."""
    made, at = read_dictionary(content)
    unpacker = zstandard.ZstdDecompressor(dict_data=made)
    view = memoryview(content)
    while at < len(content):
        if len(content) - at < 8:
            raise WarcError("the archive is cut off")
        magic, length = struct.unpack_from("<II", content, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + length
            if at > len(content):
                raise WarcError("a skippable frame is cut off")
            continue
        if magic != FRAME_MAGIC:
            raise WarcError(f"no frame begins at byte {at}")
        step = unpacker.decompressobj()
        parts, took = [], 0
        try:
            while not step.eof and at < len(content):
                piece = view[at : at + (1 << 16)]
                parts.append(step.decompress(piece))
                took += len(parts[-1])
                at += len(piece)
                if took > MAX_RECORD_BYTES:
                    raise WarcError("a record is too long")
        except zstandard.ZstdError as e:
            raise WarcError(f"a frame doesn't decode: {e}") from e
        if not step.eof:
            raise WarcError("the last frame is cut off")
        at -= len(step.unused_data)
        yield b"".join(parts)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The headers (names in lower case) and the block of a record, validated."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", VERSION):
        raise WarcError("a record has no WARC header")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise WarcError("a header line has no colon")
        headers[name.decode().strip().lower()] = value.decode().strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"a record lacks {name}")
    if not headers["content-length"].isdigit():
        raise WarcError("a length is no number")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError("a record's length differs from its header's")
    block = rest[:length]
    told = headers.get("warc-block-digest", "")
    if told.startswith("sha1:") and told[5:] != base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise WarcError("a block differs from its digest")
    return headers, block


def parse_response(headers: dict[str, str], block: bytes) -> tuple[int, str, bytes | None]:
    """Bytes and digest of the full payload, and the payload (None in a revisit), validated."""
    http, gap, payload = block.partition(b"\r\n\r\n")
    lengths = [v for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:]) if k.strip().lower() == b"content-length"]
    digest = headers.get("warc-payload-digest", "")
    if not gap or len(lengths) != 1 or not lengths[0].strip().isdigit() or not digest.startswith("sha256:"):
        raise WarcError("a record has no valid HTTP header or digest")
    size = int(lengths[0])
    if headers["warc-type"] == "revisit":
        if payload or "warc-refers-to" not in headers:
            raise WarcError("a revisit holds a payload, or refers to nothing")
        return size, digest[7:], None
    if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest[7:]:
        raise WarcError("a payload differs from its length or digest")
    return size, digest[7:], payload


_ID = "urn:page:"
ARCHIVES = "path string, content binary"
RECORDS = (
    "path string, record_type string, record_id string, refers_to string, uri string, "
    "payload_bytes long, payload_digest string, payload binary"
)


def _writer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, number, writer = TaskContext.get().partitionId(), 0, ArchiveWriter()

    def row(content: bytes) -> pa.RecordBatch:
        nonlocal number
        number += 1
        return pa.RecordBatch.from_pydict({"path": pa.array([f"part-{part:05d}-{number:05d}.warc.zst"]), "content": pa.array([content], pa.binary())})

    for batch in batches:
        for r in zip(*(batch.column(n) for n in ("record_id", "uri", "payload", "digest", "refers_to"))):
            record_id, uri, payload, digest, refers_to = (x.as_py() for x in r)
            if done := writer.add(build_record(record_id, uri, payload.encode(), digest, refers_to)):
                yield row(done)
    while done := writer.close():
        yield row(done)


def _reader(payloads: bool):
    schema = pa.schema([
        ("path", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()),
        ("uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                rows, held = [], 0
                for raw in read_frames(content.as_py()):
                    headers, block = parse_record(raw)
                    size, digest, payload = parse_response(headers, block)
                    refers_to = headers.get("warc-refers-to")
                    rows.append({
                        "path": path.as_py(), "record_type": headers["warc-type"], "record_id": headers["warc-record-id"][1:-1],
                        "refers_to": refers_to and refers_to[1:-1], "uri": headers.get("warc-target-uri"),
                        "payload_bytes": size, "payload_digest": digest, "payload": payload if payloads else None,
                    })
                    held += len(payload or b"") * payloads
                    if len(rows) >= 4096 or held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def plan_records(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """record_id, uri, payload, digest, refers_to (null in responses) of each row of ``pages`` (page_id, url, html).

    Of rows with equal payloads of at least ``min_revisit_bytes``, those with the
    smallest id are responses, the others revisit it.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload")).withColumn("digest", F.sha2("payload", 256))
    many = (
        rows.where(F.octet_length("payload") >= min_revisit_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .select("digest", "first")
    )
    # plain scans on both sides: Spark broadcasts by checked size, else splits a payload that very many pages share
    named = lambda c: F.concat(F.lit(_ID), F.coalesce(c.cast("string"), F.lit("-")))
    return rows.join(shared_table(many, "payloads"), "digest", "left").select(
        named(F.col("page_id")).alias("record_id"),
        F.coalesce("url", F.lit("")).alias("uri"),
        "payload",
        "digest",
        F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), named(F.col("first"))).alias("refers_to"),
    )


def write_archives(records: DataFrame) -> DataFrame:
    """Archives (path, content) of planned records, kept as a table in the shared folder."""
    return shared_table(records.mapInArrow(_writer, ARCHIVES), "warc")


def read_archives(files: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of archives: rows (path, content), such as those of the ``binaryFile`` source.

    An archive that breaks the format, a header that lacks a field, or a length
    or digest that differs raises ``WarcError``. No archives give no rows.
    """
    return files.select("path", "content").mapInArrow(_reader(payloads), RECORDS)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls: a null html is empty, a null url too, a null id is written as ``-`` and read as null.

    Rows that share the smallest id of a payload are all responses. Other columns
    are not read.
    """
    archives = write_archives(plan_records(table(spark, sf_dir, "pages")))
    number = lambda c: F.when(F.col(c) != f"{_ID}-", F.substring(c, len(_ID) + 1, 30)).cast("long")
    return read_archives(archives, payloads=False).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
m AS (SELECT page_id, html, octet_length(encode(html)) AS payload_bytes, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to
FROM m
"""
QUERIES = {"op4_warc": op4_warc}
ORACLES = {"op4_warc": ORACLE}
