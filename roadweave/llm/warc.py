"""WARC writing, and reading with segment reassembly (operator 6).

Writing: one record per page.  The payload is framed in chunks (chunked transfer
coding) and split over continuation records when it is long; a payload of at
least ``revisit_bytes`` that occurs again is stored once, and the other records
revisit it.  Records leave through Spark's text writer with the record separator
as line separator, so archives go to any store Spark writes to.

Reading: archives are read through Spark's text reader, one row per record, cut
at the version line.  The writer lets no block hold that line: a chunk ends
inside it.  Records are parsed by their Content-Length, continuation records are
grouped by origin identifier, ordered by segment number, checked against the
total length, and the chunk framing is decoded.

Payloads travel once to meet their digest group (a sort-merge join that splits
at hot digests); grouping by digest moves digests only.

Cases: a null html is an empty payload; of equal payloads in repeated rows with
the largest page_id all are responses; a null page_id is written as an empty
field and read back as null; an empty table gives no archive and no rows; other
columns are not archived.  A record whose length, segment numbers or total
length don't agree raises an error.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import read, scratch_path

VERSION = "WARC/1.1"
VERSION_LINE = VERSION + "\r\n"
END = "\r\n\r\n"
REVISIT_BYTES = 1000
SEGMENT_CHARS = 8192
CHUNK_CHARS = 4096
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _identifier(*parts: object) -> str:
    h = hashlib.md5("\x00".join(map(str, parts)).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def chunked(payload: str, chunk_chars: int = CHUNK_CHARS) -> str:
    """Chunked transfer coding; no chunk holds the version mark whole, so no block holds the version line."""
    out = []
    for part in _guarded(payload):
        for i in range(0, len(part), chunk_chars):
            piece = part[i : i + chunk_chars]
            out.append(f"{len(piece.encode()):x}\r\n{piece}\r\n")
    return "".join(out) + "0\r\n\r\n"


def _guarded(payload: str) -> Iterator[str]:
    head, *rest = payload.split(VERSION)
    yield head + (VERSION[:4] if rest else "")
    for i, part in enumerate(rest):
        yield VERSION[4:] + part + (VERSION[:4] if i + 1 < len(rest) else "")


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        if len(out[-1]) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at = end + 4 + size


def _record(headers: list[tuple[str, object]], block: str) -> str:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return f"{VERSION_LINE}{lines}Content-Length: {len(block.encode())}\r\n\r\n{block}"


def page_records(page_id, url, html, row, digest, kind, refers_to, segment_chars: int = SEGMENT_CHARS) -> list[str]:
    """The records of one page, without the separator that ends each."""
    payload = html or ""
    size = len(payload.encode())
    origin = _identifier("page", row)
    page = "" if page_id is None else page_id
    target = re.sub(r"[\r\n]+", " ", url).replace(VERSION, VERSION.replace("/", "%2F")) if url is not None else None
    common = [("WARC-Type", kind), ("WARC-Record-ID", origin), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", target), ("WARC-Page-ID", page), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Payload-Length: {size}\r\nTransfer-Encoding: chunked\r\n\r\n"
    if kind == "revisit":
        return [_record([*common, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To-Page-ID", refers_to)], http)]
    block = http + chunked(payload)
    cuts = list(range(0, len(block), segment_chars))
    if len(cuts) == 1:
        return [_record(common, block)]
    total = len(block.encode())
    out = [_record([*common, ("WARC-Segment-Number", 1)], block[:segment_chars])]
    for n, at in enumerate(cuts[1:], 2):
        last = ("WARC-Segment-Total-Length", total) if at == cuts[-1] else ("WARC-Segment-Total-Length", None)
        out.append(
            _record(
                [("WARC-Type", "continuation"), ("WARC-Record-ID", _identifier("page", row, n)), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Segment-Number", n), ("WARC-Segment-Origin-ID", origin), last],
                block[at : at + segment_chars],
            )
        )
    return out


def mark_revisits(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """``pages`` (page_id, url, html) with digest, kind and refers_to."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    marked = pages.select("page_id", "url", "html").withColumns(
        {"digest": F.sha1(payload), "strong": F.sha2(payload, 256), "size": F.octet_length(payload)}
    )
    groups = (
        marked.filter(F.col("size") >= revisit_bytes)
        .groupBy("strong")
        .agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select(F.col("strong").alias("group_strong"), "first_id")
    )
    found = marked.join(groups, (F.col("strong") == F.col("group_strong")) & (F.col("size") >= revisit_bytes), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return found.select(
        "page_id", "url", "html", "digest", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("first_id")).alias("refers_to")
    )


def write_warc(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES, segment_chars: int = SEGMENT_CHARS) -> None:
    """Archives under ``path``, one gzip file per task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                rows = batch.slice(i, 512).to_pylist()
                out = [x for r in rows for x in page_records(r["page_id"], r["url"], r["html"], r["row"], r["digest"], r["kind"], r["refers_to"], segment_chars)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    marked = mark_revisits(pages, revisit_bytes).withColumn("row", F.monotonically_increasing_id())
    marked.mapInArrow(work, "value string").write.option("lineSep", END).option("compression", "gzip").text(path)


def parse_record(text: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers and block of what follows a version line; None for the nothing before the first."""
    if not text.strip():
        return None
    head, found, rest = text.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n"))}
    size = int(headers["content-length"])
    if not found or len(rest) < size or rest[size:].strip():
        raise ValueError(f"record {headers.get('warc-record-id')} has not the length it states")
    return headers, rest[:size]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records as rows: id, kind, origin, segment, total, page, refers_to, digest, block."""
    names = ["id", "kind", "origin", "segment", "total", "page", "refers_to", "digest", "block"]
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def number(value: str | None) -> int | None:
        return int(value) if value else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                rows = []
                for text in batch.column(0).slice(i, 512).to_pylist():
                    if (found := parse_record(text)) is not None:
                        h, block = found
                        digest = (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None
                        rows.append((h["warc-record-id"], h["warc-type"], h.get("warc-segment-origin-id") or h["warc-record-id"], number(h.get("warc-segment-number")), number(h.get("warc-segment-total-length")), h.get("warc-page-id"), h.get("warc-refers-to-page-id"), digest, block))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    lines = spark.read.option("lineSep", VERSION_LINE).text(path).select(F.col("value").cast("binary").alias("value"))
    schema = "id string, kind string, origin string, segment int, total bigint, page string, refers_to string, digest string, block binary"
    return lines.mapInArrow(work, schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Whole pages: page_id, record_type, refers_to, stated_digest, payload (null for revisits), payload_bytes, payload_digest."""
    names = ["page_id", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"]
    types = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string()]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = []
                for r in batch.slice(i, 256).to_pylist():
                    parts = sorted(r["parts"], key=lambda p: p["segment"] or 1)
                    if [p["segment"] or 1 for p in parts] != list(range(1, len(parts) + 1)):
                        raise ValueError(f"{r['origin']} lacks a segment or has one twice")
                    block = b"".join(p["block"] for p in parts)
                    if parts[0]["segment"] is not None and parts[-1]["total"] is None:
                        raise ValueError(f"{r['origin']} lacks its last segment, which states the total length")
                    if (parts[-1]["total"] or len(block)) != len(block):
                        raise ValueError(f"{r['origin']} has not the total length it states")
                    head, _, body = block.partition(b"\r\n\r\n")
                    if r["kind"] == "revisit":
                        size = int(re.search(rb"X-Payload-Length: (\d+)", head)[1])
                        rows.append((r["page"], r["kind"], r["refers_to"], None, size, r["digest"]))
                        continue
                    payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                    digest = hashlib.sha1(payload).hexdigest()
                    if r["digest"] and r["digest"] != digest:
                        raise ValueError(f"{r['origin']} has not the payload digest it states")
                    rows.append((r["page"], r["kind"], None, payload, len(payload), digest))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    records = read_records(spark, path)
    part = F.struct("segment", "total", "block")
    whole = records.filter("segment IS NULL").select("origin", "kind", "page", "refers_to", "digest", F.array(part).alias("parts"))
    grouped = (
        records.filter("segment IS NOT NULL")
        .groupBy("origin")
        .agg(
            F.max(F.when(F.col("segment") == 1, F.col("kind"))).alias("kind"),
            F.max("page").alias("page"),
            F.max("refers_to").alias("refers_to"),
            F.max("digest").alias("digest"),
            F.collect_list(part).alias("parts"),
        )
    )
    schema = "page_id string, record_type string, refers_to string, payload binary, payload_bytes bigint, payload_digest string"
    return whole.unionByName(grouped).mapInArrow(decode, schema)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_warc(read(spark, sf_dir, "pages"), path)
    as_id = lambda c: F.when(F.col(c) != "", F.col(c)).cast("bigint").alias(c)
    return read_warc(spark, path).select(as_id("page_id"), "payload_bytes", "payload_digest", "record_type", as_id("refers_to"))


def oracle_sql() -> str:
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
g AS (SELECT html, max(page_id) AS first_id FROM p WHERE payload_bytes >= {REVISIT_BYTES} GROUP BY html)
SELECT page_id, payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN g ON p.html = g.html"""
