"""WARC archives: a writer with revisit records, and a salvage reader.

Every record is a gzip member of its own. The reader takes member after member; when one fails its checks (gzip CRC,
version line, headers, length, digests) it searches on for the next gzip member that inflates to a version line, or
in plain archives for the next version line, goes on there, and logs the bytes between as a quarantined gap with the
reason. Nothing after a damaged record is lost with it.

Archives of other writers are read as well: any version, payloads of any record type, folded headers, members of
several records, digests of any algorithm that hashlib knows in hex or base32; a missing or unknown digest is not
checked. A record with a number that is none (X-Page-Id and the like) is quarantined like a damaged one.

Archives are rows (name, content) of about ARCHIVE_BYTES each. Defined results: null html counts as empty; a payload's
response is decided by page_id and payload together, so rows that repeat a page_id with another payload are records of
their own, and rows equal in both are the same kind of record each; rows without page_id revisit the payload's smallest
page_id if there is one; an empty table gives no archives; empty content gives neither records nor gaps.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_ROWS, table, with_match, written

ARCHIVE_BYTES = 4 << 20
#: Payloads below this size are never revisits.
LEAST_REVISIT = 100
#: Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_END = b"\r\n\r\n"


@dataclass
class Record:
    """A record and where it stood: headers (lower-case names), block and byte range."""

    headers: dict[str, str]
    block: bytes
    start: int
    end: int


def record_id(page_id: int | None, digest: str, kind: str = "response") -> str:
    """The id of a page's record with this payload; rows that are equal in all three share it."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}/{digest}/{kind}')}>"


def digest_fits(named: str, data: bytes) -> bool:
    """Whether `algorithm:value`, in hex or base32, is the digest of data. Unknown algorithms prove nothing."""
    name, _, value = named.strip().partition(":")
    name, value = name.lower().replace("-", ""), value.strip()
    if name not in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"):
        return True
    found = hashlib.new(name, data).digest()
    return value.lower() == found.hex() or value.upper().rstrip("=") == base64.b32encode(found).decode().rstrip("=")


def record(kind: str, page_id: int | None, uri: str, payload: bytes, digest: str, refers_to: int | None = None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """A record as a gzip member. A response holds the payload; a revisit names its response instead."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest, kind)}", f"WARC-Date: {date}", f"WARC-Target-URI: {' '.join((uri or '').split())}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Bytes: {len(payload)}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    raw = VERSION + "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + _END + block + _END
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


_FIRST = re.compile(rb"WARC/\d+\.\d+\r\n")


def parse(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the plain record at a place. ValueError tells which check failed."""
    if not _FIRST.match(raw, at):
        raise ValueError("no version line")
    stop = raw.find(_END, at)
    if stop < 0:
        raise ValueError("headers are cut off")
    headers, last = {}, None
    for line in raw[at:stop].split(b"\r\n")[1:]:
        if line[:1] in (b" ", b"\t") and last:  # a folded header goes on
            headers[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("a header without a colon")
        last = name.strip().decode("utf-8", "replace").lower()
        headers[last] = value.strip().decode("utf-8", "replace")
    size = headers.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", size):
        raise ValueError("no content length")
    first, end = stop + 4, stop + 4 + int(size)
    if raw[end : end + 4] != _END:
        raise ValueError("the block is cut off")
    block = raw[first:end]
    if not digest_fits(headers.get("warc-block-digest", ""), block):
        raise ValueError("the block digest differs")
    return headers, block, end + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int]:
    """A gzip member's content and its end."""
    d = zlib.decompressobj(31)
    try:
        raw = d.decompress(memoryview(data)[at:])
    except zlib.error as e:
        raise ValueError("a damaged gzip member") from e
    if not d.eof:
        raise ValueError("a gzip member is cut off")
    return raw, len(data) - len(d.unused_data)


def _begins(data: bytes, at: int) -> bool:
    """Whether a gzip member at a place inflates to a version line."""
    try:
        return zlib.decompressobj(31).decompress(memoryview(data)[at : at + 512], 5) == b"WARC/"
    except zlib.error:
        return False


def salvage(data: bytes) -> tuple[list[Record], list[tuple[int, int, str]]]:
    """Records of an archive and its quarantined gaps (start, end, reason)."""
    records, gaps, at = [], [], 0
    gap, why = -1, ""
    while at < len(data):
        found, holes = [], []
        try:
            if data[at : at + 2] == b"\x1f\x8b":
                # members are short: most inflate from a slice, which spares a copy of the rest
                for size in (1 << 16, 1 << 20, len(data)):
                    try:
                        raw, end = _inflate(data[at : at + size], 0)
                        end += at
                        break
                    except ValueError:
                        if at + size >= len(data):
                            raise
                if raw[:5] != b"WARC/":
                    raise ValueError("no version line")
                inner, holes = salvage(raw)  # one record as a rule
                if not inner:
                    raise ValueError(holes[0][2])
                found = [Record(r.headers, r.block, at, end) for r in inner]
            else:
                headers, block, end = parse(data, at)
                found = [Record(headers, block, at, end)]
        except ValueError as e:
            if gap < 0:
                gap, why = at, str(e)
            to = at + 1
            while True:
                zipped, plain = data.find(b"\x1f\x8b\x08", to), data.find(b"WARC/", to)
                if zipped < 0 and plain < 0:
                    at = len(data)
                    break
                if plain >= 0 and (zipped < 0 or plain < zipped):
                    at = plain
                    break
                if _begins(data, zipped):
                    at = zipped
                    break
                to = zipped + 1
            continue
        if gap >= 0:
            gaps.append((gap, at, why))
            gap = -1
        records += found
        gaps += [(at, end, why_inside) for _, _, why_inside in holes]
        at = end
    if gap >= 0:
        gaps.append((gap, len(data), why))
    return records, gaps


def payload(r: Record) -> bytes:
    """A record's payload: what follows the block's HTTP headers, or the block if it is no HTTP message."""
    return r.block.partition(_END)[2] if r.block[:5] == b"HTTP/" else r.block


def _unchunked(r: Record, body: bytes) -> bytes:
    """A body freed of chunked transfer coding, if its HTTP headers name it; what is malformed stays as it is."""
    head = r.block.partition(_END)[0].lower()
    if not re.search(rb"\r\ntransfer-encoding:[^\r]*chunked", head):
        return body
    out, at = [], 0
    while m := re.compile(rb"([0-9a-fA-F]{1,8})[^\r\n]*\r\n").match(body, at):
        size = int(m[1], 16)
        if not size:
            return b"".join(out)
        out.append(body[m.end() : m.end() + size])
        at = m.end() + size + 2
    return body


def with_types(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with digest and refers_to (null: a response).

    Digests are grouped without the html, so a payload shared by any number of pages is first reduced to its least
    page_id. Rows get their response by page_id and digest, by a broadcast only when the revisits are few.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    small = pages.where(F.octet_length("html") >= LEAST_REVISIT).select("page_id", "digest")
    first = small.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1 and first is not null")
    again = with_match(small.distinct(), "digest", first, "inner").where("not (page_id <=> first)")
    again = written(again.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), F.col("first").alias("refers_to")), "revisits")
    few = again.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    same = pages["page_id"].eqNullSafe(F.col("_page")) & (pages["digest"] == F.col("_digest"))
    return pages.join(F.broadcast(again) if few else again.hint("merge"), same, "left").drop("_page", "_digest")


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives (name, content) of pages with refers_to (null: a response)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def archive() -> pa.RecordBatch:
            content = b"".join(held)
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(content).hexdigest()[:32] + ".warc.gz"]), pa.array([content], pa.large_binary()).cast(pa.binary())], names=["name", "content"])

        for b in batches:
            for page_id, url, html, refers_to in zip(*(b.column(k) for k in range(4))):
                body = html.as_buffer().to_pybytes() if html.as_buffer() else b""
                digest = hashlib.sha256(body).hexdigest()
                held.append(record("response" if refers_to.as_py() is None else "revisit", page_id.as_py(), url.as_py(), body, digest, refers_to.as_py()))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield archive()
                    held, size = [], 0
        if held:
            yield archive()

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(rows, "name string, content binary")


def _number(text: str | None) -> int | None:
    if text and not re.fullmatch(r"-?[0-9]{1,19}", text):
        raise ValueError("a number that is none")
    if text and not -(2**63) <= int(text) < 2**63:
        raise ValueError("a number out of range")
    return int(text) if text else None


def _fields(r: Record) -> tuple:
    """page_id, record_type, payload_bytes, payload_digest (bare), refers_to, url, payload and record_id of a record."""
    h, kind = r.headers, r.headers.get("warc-type")
    named, body = h.get("warc-payload-digest", ""), payload(r)
    page, refers, size = (_number(h.get(k)) for k in ("x-page-id", "x-refers-to-page", "x-payload-bytes"))
    if kind == "revisit":
        return page, kind, size, named.partition(":")[2], refers, h.get("warc-target-uri"), None, h.get("warc-record-id")
    if not digest_fits(named, body) and not digest_fits(named, _unchunked(r, body)):
        raise ValueError("the payload digest differs")
    return page, kind, len(body), hashlib.sha256(body).hexdigest(), refers, h.get("warc-target-uri"), body, h.get("warc-record-id")


def read_archives(archives: DataFrame) -> DataFrame:
    """A row per salvaged record (gap_reason null) and per quarantined gap of archives (name, content). Payloads are
    those of all records but revisits; payload_digest is the payload's SHA-256, a revisit's the value it names."""
    schema = "name string, start long, end long, gap_reason string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, url string, payload binary, record_id string"
    arrow = pa.schema([("name", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("gap_reason", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("record_id", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                records, gaps = salvage(content or b"")
                found = []
                for r in records:
                    try:
                        found.append((name, r.start, r.end, None, *_fields(r)))
                    except ValueError as e:
                        gaps.append((r.start, r.end, str(e)))
                found += [(name, s, e, why, *[None] * 8) for s, e, why in gaps]
                for a in range(0, len(found), 500):
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*found[a : a + 500]), arrow)], schema=arrow)

    return archives.select("name", "content").mapInArrow(rows, schema)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives in the shared folder and read back."""
    archives = written(write_archives(with_types(table(spark, sf_dir, "pages"))), "warc")
    return read_archives(archives).where("gap_reason is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {LEAST_REVISIT} GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.first IS NULL OR f.first = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first IS DISTINCT FROM p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest AND p.payload_bytes >= {LEAST_REVISIT}
"""
