"""Web archives packed in ZIP files, written and read back by Spark tasks.

An archive is a ZIP file with stored members: ``archive/data.warc.gz``, one gzip member per WARC record, and
``indexes/index.cdxj``, one line per record with its offset and length. A page whose payload, of at least 100 bytes,
also stands at a smaller page_id is a revisit that refers there and carries no payload.

Reading takes two steps: a task per archive parses the ZIP directories and the index and gives out ranges of records;
then the ranges, dealt evenly, are read from the stored member and parsed. No archive is extracted or read as a whole.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendscope.llm.common import cut, shared_dir, table
from spendscope.llm.zip_reader import STORED, members

SMALLEST = 100  # bytes of a payload that a revisit may refer to
ARCHIVE_BYTES = 64_000_000  # a task begins another archive beyond it
RANGE_BYTES = 4_000_000
RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "1970-01-01T00:00:00Z"  # records are the same at every run


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI, and the path there."""
    local = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), local) if "://" not in local else fs.FileSystem.from_uri(path)


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(name: str | None) -> int | None:
    digits = name[10:-1] if name else ""
    return int(digits) if digits else None


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": record_id(page_id), "WARC-Date": DATE,
        "WARC-Payload-Digest": "sha256:" + hashlib.sha256(payload).hexdigest(),
        "Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block)),
    }
    if url is not None:
        head["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    if revisit:
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["WARC-Refers-To"] = record_id(refers_to)
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse_record(data: bytes) -> dict:
    """Headers of the record and of the HTTP message in it, and the payload (empty for a revisit)."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    warc = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    block = rest[: int(warc["content-length"])]
    http_head, _, payload = block.partition(b"\r\n\r\n")
    http = {k.lower(): v for k, _, v in (line.partition(": ") for line in http_head.decode("latin-1").split("\r\n")[1:])}
    return {"warc": warc, "http": http, "payload": payload}


class _Archive:
    """One ZIP file being written under a task's own name; it gets its final name when it is whole."""

    def __init__(self, folder: str, name: str, attempt: str):
        self.store, path = file_system(folder)
        self.final, self.draft = f"{path}/{name}", f"{path}/.{name}.{attempt}"
        self.uri = f"{folder}/{name}"
        self.stream = self.store.open_output_stream(self.draft)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(RECORDS, "w", force_zip64=True)
        self.size, self.index = 0, []

    def add(self, page_id: int | None, url: str | None, record: bytes) -> None:
        self.member.write(record)
        self.index.append(f"{'-' if page_id is None else page_id} 19700101000000 " + json.dumps(
            {"url": url, "offset": str(self.size), "length": str(len(record)), "filename": "data.warc.gz"}
        ))
        self.size += len(record)

    def close(self) -> tuple[str, int]:
        self.member.close()
        self.zip.writestr(INDEX, "".join(line + "\n" for line in self.index))
        self.zip.close()
        self.stream.close()
        self.store.move(self.draft, self.final)
        return self.uri, len(self.index)


def marked_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, html, refers_to, revisit. Pages travel once, dealt by id; equal payloads meet as digests."""
    raw = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha2(raw, 256).alias("digest"))
    long = pages.where(F.octet_length("html") >= SMALLEST).select("page_id", F.sha2(raw, 256).alias("digest"))
    first = long.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "refers_to")
    later = long.where("page_id is not null").distinct().join(first, "digest").where("page_id <> refers_to")
    return rows.join(later, ["page_id", "digest"], "left").select(
        "page_id", "url", "html", "refers_to", F.col("refers_to").isNotNull().alias("revisit")
    )


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes records for all rows of ``marked_pages`` and returns (path, records), one row per archive.

    The result must be evaluated once (see ``cut``). A repeated task replaces its archives as a whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), f"{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        done, archive = [], None
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("page_id", "url", "html", "refers_to", "revisit")]
            for page_id, url, html, refers_to, revisit in zip(*columns, strict=True):
                if archive is None:
                    archive = _Archive(folder, f"part-{part:06d}-{len(done):04d}.wacz", attempt)
                archive.add(page_id, url, warc_record(page_id, url, (html or "").encode(), refers_to, revisit))
                if archive.size >= archive_bytes:
                    done.append(archive.close())
                    archive = None
        if archive is not None:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "records"]
            )

    return pages.mapInArrow(run, "path string, records long")


def record_ranges(path: str, range_bytes: int = RANGE_BYTES) -> Iterator[tuple[str, list[int], list[int]]]:
    """(path, offsets in the file, lengths) of neighbouring records, from the directories and indexes alone."""
    store, at = file_system(path)
    with store.open_input_file(at) as file:
        found = {m.name: m for m in members(file)}
        for name, member in found.items():
            if not (name.startswith("indexes/") and name.endswith(".cdxj")) or member.method != STORED:
                continue
            offsets, lengths, size = [], [], 0
            starts: dict[str, int] = {}
            for line in bytes(file.read_at(member.size, member.start(file))).decode().split("\n"):
                if not line:
                    continue
                entry = json.loads(line.split(" ", 2)[2])
                data = found["archive/" + entry["filename"]]
                if data.method != STORED:
                    raise ValueError(f"{data.name} is not stored")
                if data.name not in starts:
                    starts[data.name] = data.start(file)
                offsets.append(starts[data.name] + int(entry["offset"]))
                lengths.append(int(entry["length"]))
                size += lengths[-1]
                if size >= range_bytes:
                    yield path, offsets, lengths
                    offsets, lengths, size = [], [], 0
            if offsets:
                yield path, offsets, lengths


def read_archives(archives: DataFrame, range_bytes: int = RANGE_BYTES, partitions: int | None = None, payloads: bool = True) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url (, payload) for every record of ``path``s.

    A response's size and digest are taken from its payload, and the digest must be the recorded one; a revisit's
    are those that its headers record, and its payload is null.
    """

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                for found in record_ranges(path, range_bytes):
                    yield pa.RecordBatch.from_pylist([dict(zip(("path", "offsets", "lengths"), found, strict=True))], pa.schema(
                        [("path", pa.string()), ("offsets", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))]
                    ))

    kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
             ("refers_to", pa.int64()), ("url", pa.string()), *[("payload", pa.binary())] * payloads]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offsets, lengths in zip(*(batch.column(n).to_pylist() for n in ("path", "offsets", "lengths")), strict=True):
                store, at = file_system(path)
                with store.open_input_file(at) as file:
                    base = min(offsets)
                    joined = max(o + n for o, n in zip(offsets, lengths, strict=True)) - base == sum(lengths)
                    whole = bytes(file.read_at(sum(lengths), base)) if joined else None
                    rows = []
                    for offset, n in zip(offsets, lengths, strict=True):
                        rows.append(_row(parse_record(whole[offset - base : offset - base + n] if joined else bytes(file.read_at(n, offset))), payloads))
                yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

    partitions = partitions or archives.sparkSession.sparkContext.defaultParallelism * 4
    ranges = archives.select("path").mapInArrow(locate, "path string, offsets array<long>, lengths array<long>")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    return ranges.repartition(partitions).mapInArrow(read, schema + ", payload binary" * payloads)


def _row(record: dict, payloads: bool) -> dict:
    warc, revisit = record["warc"], record["warc"]["warc-type"] == "revisit"
    digest = warc["warc-payload-digest"].removeprefix("sha256:")
    if not revisit and hashlib.sha256(record["payload"]).hexdigest() != digest:
        raise ValueError(f"digest of {warc['warc-record-id']} differs")
    row = {
        "page_id": page_of(warc["warc-record-id"]),
        "payload_bytes": int(record["http"]["content-length"]) if revisit else len(record["payload"]),
        "payload_digest": digest, "record_type": warc["warc-type"], "refers_to": page_of(warc.get("warc-refers-to")),
        "url": warc.get("warc-target-uri"),
    }
    return row | {"payload": None if revisit else record["payload"]} if payloads else row


def archive_pages(pages: DataFrame, folder: str | None = None, payloads: bool = False, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes all ``pages`` to archives in a new folder below ``folder`` (else the shared one) and reads them back.

    Null html is an empty payload; a null url is left out; rows without page_id are responses. Repeated rows with
    the least page_id of a payload are all responses. Other columns are ignored. An empty table makes no archive.
    """
    folder = f"{(folder or shared_dir(pages.sparkSession)).rstrip('/')}/archives-{uuid.uuid4().hex}"
    store, path = file_system(folder)
    store.create_dir(path)
    return read_archives(cut(write_archives(marked_pages(pages), folder, archive_bytes)), payloads=payloads)


def op2_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


SQL = """
SELECT page_id, bytes AS payload_bytes, sha256(payload) AS payload_digest,
       CASE WHEN bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN bytes >= 100 AND page_id > first THEN first END AS refers_to, url
FROM (
  SELECT page_id, url, coalesce(html, '') AS payload, octet_length(encode(coalesce(html, ''))) AS bytes,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages
)
"""
