"""WARC archives: writing pages as segmented, chunked records, and reassembling them on reading.

Writing: a page is a `response` record whose block is an HTTP message in chunked transfer framing.
Of pages with equal payloads of at least REVISIT_BYTES, that with the largest id is stored and the
others are `revisit` records that name it. Blocks above SEGMENT_BYTES are split: the first segment
stands in the response, the rest in `continuation` records that carry the origin's identifier and a
segment number; the last one also has the total length. Spark's text writer puts the records into
files (the line separator is the empty lines that end a record), so any store that Spark reaches will do.

Reading: continuation records are grouped by origin identifier, ordered by segment number, checked
against the total length, joined, and freed of the chunked framing; digests are checked.

Defined cases: a null payload is empty; a null url is written as an empty target; a null id is
written as an empty field and read back as null; repeated rows (same id and payload) are all stored
as the first would be, and come back as often; a wrong digest, missing segment, wrong total length or
broken framing raises ValueError.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, durable, shared_dir

REVISIT_BYTES = 1000
SEGMENT_BYTES = 1 << 14
CHUNK_BYTES = 4096
#: Records in one archive file; with SEGMENT_BYTES it bounds what a reader holds.
FILE_RECORDS = 512
END = "\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = []
    for i in range(0, len(payload), size):
        piece = payload[i : i + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(framed: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        stop = framed.find(b"\r\n", at)
        if stop < 0:
            raise ValueError("chunk size without end of line")
        n = int(framed[at:stop].split(b";")[0], 16)
        at = stop + 2
        if n == 0:
            return b"".join(out)
        if framed[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk of another length than stated")
        out.append(framed[at : at + n])
        at += n + 2


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{page_id}|{digest}'.encode()).hexdigest())}>"


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def page_records(page_id, url: str, payload: bytes, digest: str, refers_to, segment: int = SEGMENT_BYTES) -> list[bytes]:
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    own = record_id(page_id, digest)
    base = [("WARC-Record-ID", own), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", "" if page_id is None else page_id), ("X-Payload-Length", len(payload))]
    if refers_to is not None:
        return [record([("WARC-Type", "revisit"), *base, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-ID", refers_to)], HTTP)]
    block = HTTP + chunked(payload)
    kind = [("WARC-Type", "response"), *base, ("Content-Type", "application/http;msgtype=response")]
    if len(block) <= segment:
        return [record(kind, block)]
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = [record([*kind, ("WARC-Segment-Number", 1)], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        total = [("WARC-Segment-Total-Length", len(block))] if n == len(parts) else []
        out.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{own}|{n}'.encode()).hexdigest())}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", n), *total], part))
    return out


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive."""
    at = 0
    while at < len(archive):
        stop = archive.find(b"\r\n\r\n", at)
        lines = archive[at:stop].decode().split("\r\n")
        if stop < 0 or not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record begins here")
        headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
        start = stop + 4
        end = start + int(headers["content-length"])
        if archive[end : end + 4] != b"\r\n\r\n":
            raise ValueError("record of another length than stated")
        yield headers, archive[start:end]
        at = end + 4


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Writes a record, or several segments, per row into gzip-compressed archives in folder."""
    arrow_rows(pages.sparkSession, 200)
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.encode(F.coalesce(payload, F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= REVISIT_BYTES
    # written first: a join with rows that come by a shuffle of their own can split a digest that many pages share
    stored = durable(rows.where(large).groupBy("digest").agg(F.max("page_id").alias("stored"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-stored", few=True)
    rows = rows.join(stored, "digest", "left").withColumn("refers_to", F.when(F.col("stored").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("stored")), F.col("stored")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [x for r in batch.to_pylist() for x in page_records(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"])]
            for i in range(0, len(made), FILE_RECORDS):
                yield pa.RecordBatch.from_arrays([pa.array(made[i : i + FILE_RECORDS], pa.binary())], names=["record"])

    rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(folder)


OUT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]


def number(text: str | None) -> int | None:
    return int(text) if text else None


def whole(headers: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    """The result row of a complete block."""
    said = headers["warc-payload-digest"].removeprefix("sha1:")
    if headers["warc-type"] == "revisit":
        return number(headers["x-page-id"]), int(headers["x-payload-length"]), said, "revisit", number(headers["x-refers-to-page-id"]), None
    payload = unchunked(block[block.index(b"\r\n\r\n") + 4 :])
    digest = hashlib.sha1(payload).hexdigest()
    if digest != said:
        raise ValueError(f"payload of {headers['warc-record-id']} has another digest than stated")
    return number(headers["x-page-id"]), len(payload), digest, "response", None, payload if with_payload else None


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(NAMES), KINDS, strict=True)], names=NAMES)


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (and payload) of every page in the archives."""
    arrow_rows(spark, 4)
    files = spark.read.format("binaryFile").load(folder).select("content")
    out = f"{OUT}, payload binary"

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                yield batch_of([whole(h, b, with_payload) for h, b in records(gzip.decompress(content.as_py())) if "warc-segment-number" not in h])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                found = [(h.get("warc-segment-origin-id", h["warc-record-id"]), int(h["warc-segment-number"]), number(h.get("warc-segment-total-length")), "\r\n".join(f"{k}: {v}" for k, v in h.items()) if h["warc-type"] != "continuation" else None, b) for h, b in records(gzip.decompress(content.as_py())) if "warc-segment-number" in h]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[]] * 5, (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["origin", "segment", "total", "head", "block"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                by: dict[int, list] = {}
                for part in r["parts"]:
                    by.setdefault(part["segment"], []).append(part)
                last = max(by)
                if sorted(by) != list(range(1, last + 1)) or by[last][0]["total"] is None or by[1][0]["head"] is None:
                    raise ValueError(f"a segment of {r['origin']} is missing")
                block = b"".join(by[n][0]["block"] for n in range(1, last + 1))
                if len(block) != by[last][0]["total"]:
                    raise ValueError(f"{r['origin']} has another total length than stated")
                head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in by[1][0]["head"].split("\r\n"))
                rows += [whole(head, block, with_payload)] * len(by[1])
            yield batch_of(rows)

    parts = files.mapInArrow(segments, "origin string, segment int, total long, head string, block binary")
    split = parts.groupBy("origin").agg(F.collect_list(F.struct("segment", "total", "head", "block")).alias("parts")).mapInArrow(joined, out)
    both = files.mapInArrow(single, out).unionByName(split)
    return both if with_payload else both.drop("payload")


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder, key, url, payload)
    return read_archives(pages.sparkSession, folder).withColumnRenamed("page_id", key)
