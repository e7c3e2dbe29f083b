"""WARC archives, index first: records written with an index, and read back by coalesced byte ranges."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, written

#: Payloads of fewer bytes are always written in full.
SMALLEST = 1000
#: Bytes of an archive before a task begins another; bytes between two records that are read over; bytes of one read.
ARCHIVE, GAP, READ = 256 << 20, 64 << 10, 8 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:x-page:"
INDEX = "page_id long, url string, record_type string, file string, offset long, length long, digest string"


def _safe(url: str) -> str:
    """url without what would break a header line."""
    return re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", url)


def _base32(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One gzip member: a response, or a revisit of the page refers_to, whose payload is left out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_safe(url)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{_base32(digest)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + pack.flush()


def parsed(member: bytes) -> dict:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of a record, its payload checked."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    if not version.startswith("WARC/") or len(rest) != int(fields["Content-Length"]) + 4:
        raise ValueError(f"no whole record: {head[:200]!r}")
    http, _, payload = rest[:-4].partition(b"\r\n\r\n")
    size = int(re.search(rb"(?mi)^Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload differs from its digest: {head[:200]!r}")
    number = lambda x: int(x) if (x := x.strip("<>").removeprefix(URN)) else None
    refers = number(fields["WARC-Refers-To"]) if kind == "revisit" else None
    return {"page_id": number(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": refers, "payload": payload if kind == "response" else None}


def planned(pages: DataFrame, smallest: int = SMALLEST) -> DataFrame:
    """page_id, url, payload, digest and refers_to (null for responses) of every row.

    Which payloads repeat is found on ids and digests alone; only the pages that refer to another are joined, by
    their own id, so that no payload travels by a digest that many pages share.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    thin = rows.where(F.octet_length("payload") >= smallest).select("page_id", "digest")
    last = thin.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL").drop("n")
    revisits = thin.distinct().join(last, "digest").where("NOT page_id <=> refers_to")
    r, v = rows.alias("r"), revisits.alias("v")
    on = F.col("r.page_id").eqNullSafe(F.col("v.page_id")) & (F.col("r.digest") == F.col("v.digest"))
    return r.join(v, on, "left").select("r.page_id", "url", "payload", "r.digest", "refers_to")


def _uri(folder: str) -> str:
    """folder as pyarrow wants it: with a scheme, and file: with three slashes."""
    return re.sub(r"^(?:file:/*)?/(?!/)", "file:///", folder) if folder.startswith(("/", "file:")) else folder


def write(pages: DataFrame, folder: str | None = None, smallest: int = SMALLEST, archive: int = ARCHIVE) -> DataFrame:
    """The index of archives written to `folder` (by default a new one in the shared folder).

    Each task writes archives of its own under new names, so that a task that is run again leaves the
    index right: the index has the records of finished tasks only. Null html is an empty
    payload, a null url has no target header; a null page_id is kept. Of equal payloads of at least `smallest`
    bytes, the rows with the largest page_id are responses and the others revisit it.
    """
    spark = pages.sparkSession
    folder = _uri(folder or shared_dir(spark))

    def save(batches):
        disk, path = fs.FileSystem.from_uri(folder)
        out, name, at = None, "", 0
        kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("digest", pa.string())])
        try:
            for b in batches:
                rows = []
                for r in b.to_pylist():
                    if out is None:
                        disk.create_dir(path, recursive=True)
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = disk.open_output_stream(f"{path}/{name}", compression=None)
                    data = record(r["page_id"], r["url"], r["payload"].encode(), r["digest"], r["refers_to"])
                    out.write(data)
                    rows.append({"page_id": r["page_id"], "url": r["url"], "record_type": "response" if r["refers_to"] is None else "revisit", "file": f"{folder}/{name}", "offset": at, "length": len(data), "digest": r["digest"]})
                    at += len(data)
                    if at >= archive:
                        out.close()
                        out = None
                yield pa.RecordBatch.from_pylist(rows, kinds)
        finally:
            if out is not None:
                out.close()

    return written(planned(pages, smallest).mapInArrow(save, INDEX))


def ranges(rows: list[tuple[int, int]], gap: int = GAP, most: int = READ) -> Iterator[tuple[int, int, int, int]]:
    """(first, end, offset, length) of one read each, over sorted (offset, length) of one archive."""
    first = 0
    while first < len(rows):
        begin, end, last = rows[first][0], sum(rows[first]), first + 1
        while last < len(rows) and rows[last][0] - end <= gap and sum(rows[last]) - begin <= most:
            end = max(end, sum(rows[last]))
            last += 1
        yield first, last, begin, end - begin
        first = last


def read(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records that rows of the index name, read by ranges in the order of archive and offset."""
    columns = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    columns += ", payload binary" if with_payload else ""
    kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    if with_payload:
        kinds = kinds.append(pa.field("payload", pa.binary()))

    def load(batches):
        for b in batches:
            rows = b.to_pylist()
            at = 0
            while at < len(rows):
                file, to = rows[at]["file"], at
                while to < len(rows) and rows[to]["file"] == file:
                    to += 1
                disk, path = fs.FileSystem.from_uri(file)
                with disk.open_input_file(path) as archive:
                    for first, last, begin, length in ranges([(r["offset"], r["length"]) for r in rows[at:to]]):
                        data = archive.read_at(length, begin)
                        own = rows[at:to][first:last]
                        out = [parsed(data[r["offset"] - begin : r["offset"] - begin + r["length"]]) for r in own]
                        yield pa.RecordBatch.from_pylist([{c: x[c] for c in kinds.names} for x in out], kinds)
                at = to

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    due = index.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return due.mapInArrow(load, columns)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p),
r AS (SELECT *, payload_bytes >= 1000 AND page_id <> last AS again FROM q)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last END AS refers_to
FROM r
"""
