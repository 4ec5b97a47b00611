"""WARC archives: written with segmented records and chunked bodies, read back by segment reassembly.

Defined results: a null page body is an empty payload; a null url leaves out the target header; a null page_id leaves
out the page header and comes back as null. Rows that repeat page_id and payload are written and returned as often as
they come. An empty table gives an empty archive. Columns other than page_id, url and html are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, map_rows

#: Bytes of a record's block above which it is split into continuation records.
SEGMENT_BYTES = 16_384
#: Bytes of a chunk of the transfer framing.
CHUNK_BYTES = 4_096
#: Records of one archive file: with SEGMENT_BYTES, this bounds what a reader holds.
RECORDS_PER_FILE = 4_000
#: Shorter payloads are never stored as revisits.
REVISIT_FROM = 100

CRLF = b"\r\n"


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(framed: bytes) -> bytes:
    """The body inside chunked transfer framing; ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = framed.index(CRLF, at)
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if framed[at + size : at + size + 2] != CRLF:
            raise ValueError("chunk without end")
        out.append(framed[at : at + size])
        at += size + 2


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest[:32]}>"


def header(pairs: list[tuple[str, object]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in pairs if v is not None) + CRLF


def page_records(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, segment_bytes: int) -> list[bytes]:
    """The records of one page, without the blank lines that end each."""
    rid = record_id(page_id, digest)
    target = None if url is None else quote(url, safe=":/?#[]@!$&'()*+,;=%~")
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", rid), ("WARC-Date", "2020-01-01T00:00:00Z"), ("WARC-Target-URI", target), ("WARC-Page-ID", page_id), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, digest))]
        return [header([*head, *more, ("Content-Length", len(block))]) + block]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment_bytes:
        return [header([*head, ("Content-Length", len(block))]) + block]
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = [header([*head, ("WARC-Segment-Number", 1), ("Content-Length", len(parts[0]))]) + parts[0]]
    for k, part in enumerate(parts[1:], 2):
        total = len(block) if k == len(parts) else None
        out.append(header([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{rid[:-1]}:{k}>"), ("WARC-Date", "2020-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", total), ("Content-Length", len(part))]) + part)
    return out


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write pages(page_id, url, html) as gzip WARC files under path.

    Only digests and ids are gathered to find the smallest page_id of each payload, with partial sums before the shuffle.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    owner = rows.where(F.octet_length("payload") >= REVISIT_FROM).groupBy("digest").agg(F.min("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1").select("digest", "owner")
    joined = rows.join(owner, "digest", "left").select("page_id", "url", "payload", "digest", F.when(F.col("page_id") != F.col("owner"), F.col("owner")).alias("refers_to"))

    def setup():
        return lambda *page: [(r,) for r in page_records(*page, segment_bytes)]

    out = map_rows(joined, ["page_id", "url", "payload", "digest", "refers_to"], pa.schema([("record", pa.binary())]), "record binary", setup)
    # The text sink writes the bytes as they are, with the two blank lines that end a record as its separator.
    out.select(F.col("record").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an uncompressed archive: header fields in lower case, block."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines[1:])}
        start, size = end + 4, int(fields["content-length"])
        if data[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} isn't as long as it says")
        yield fields, data[start : start + size]
        at = start + size + 4


def gunzip(data: bytes) -> bytes:
    """All gzip members of data."""
    out = []
    while data:
        d = zlib.decompressobj(31)
        out.append(d.decompress(data) + d.flush())
        data = d.unused_data
    return b"".join(out)


def entity(fields: dict[str, str], block: bytes) -> tuple:
    """A whole record's row: page_id, url, record_type, refers_to, payload_bytes, digest, payload."""
    head, _, body = block.partition(b"\r\n\r\n")
    http = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in head.decode().split("\r\n")[1:])}
    page = fields.get("warc-page-id")
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    row = (None if page is None else int(page), fields.get("warc-target-uri"), fields["warc-type"])
    if fields["warc-type"] == "revisit":
        return *row, int(re.fullmatch(r"<urn:page:(-?\d*):\w+>", fields["warc-refers-to"])[1]), int(http["content-length"]), digest, None
    if http.get("transfer-encoding") == "chunked":
        body = unchunked(body)
    return *row, None, len(body), hashlib.sha256(body).hexdigest(), body


COLUMNS = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"
TYPES = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]


def reassemble(parts: pd.DataFrame) -> pd.DataFrame:
    """One record from its segments, ordered by number and held against the total length.

    Equal rows of the input make equal segments: each number then comes equally often, and the record is returned so often.
    """
    by = defaultdict(list)
    for x in parts.to_dict("records"):
        by[int(x["segment"])].append(x)
    numbers, copies = sorted(by), {len(v) for v in by.values()}
    first, block = by[1][0], b"".join(bytes(by[k][0]["block"]) for k in numbers)
    total = next(int(x["total"]) for x in by[numbers[-1]])
    if numbers != list(range(1, len(numbers) + 1)) or len(copies) != 1 or total != len(block):
        raise ValueError(f"segments of {first['origin']} are not whole")
    row = entity(dict(item.split("\t", 1) for item in first["fields"].split("\n")), block)
    return pd.DataFrame([row] * copies.pop(), columns=[k for k, _ in TYPES], dtype=object)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All responses and revisits of the gzip archives under path, with their whole payloads (null for revisits).

    Unsegmented records end in the task that reads them; only segments are shuffled, by the origin they belong to.
    """
    files = spark.read.format("binaryFile").load(path).where(F.col("length") > 0)

    def whole():
        return lambda data: (entity(f, b) for f, b in parse(gunzip(data)) if "warc-segment-number" not in f)

    def segments():
        def of(data: bytes):
            for f, b in parse(gunzip(data)):
                if number := f.get("warc-segment-number"):
                    fields = "\n".join(f"{k}\t{v}" for k, v in f.items()) if number == "1" else None
                    yield f.get("warc-segment-origin-id", f["warc-record-id"]), int(number), int(f.get("warc-segment-total-length", 0)), fields, b

        return of

    done = map_rows(files, ["content"], pa.schema(TYPES), COLUMNS, whole, 256)
    parts = map_rows(files, ["content"], pa.schema([("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("fields", pa.string()), ("block", pa.binary())]), "origin string, segment int, total bigint, fields string, block binary", segments, 256)
    return done.unionByName(parts.groupBy("origin").applyInPandas(reassemble, COLUMNS))


def with_payloads(records: DataFrame) -> DataFrame:
    """records of read_archives() in which a revisit has the payload of the response that it refers to (null if that is missing)."""
    held = records.where("record_type = 'response' AND page_id IS NOT NULL").groupBy(F.col("page_id").alias("__id"), F.col("payload_digest").alias("__digest")).agg(F.first("payload").alias("__payload"))
    same = (F.col("refers_to") == F.col("__id")) & (F.col("payload_digest") == F.col("__digest"))
    return records.join(held, same, "left").withColumn("payload", F.coalesce("payload", "__payload")).select(*records.columns)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS lowest FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> lowest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> lowest THEN lowest END AS refers_to
FROM f
"""
