"""WARC archives in Zstandard: a dictionary in the leading skippable frame, then one frame for each record.

Identical payloads are stored once: the record of the smallest page is a
response, the others revisit it and hold the HTTP head only.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoreach.llm.common import hot_join, map_batches, materialize

DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
#: Raw bytes of records after which a new archive begins.
ARCHIVE_BYTES = 4 << 20
#: Pages that the dictionary is trained on at most, and its bytes.
DICT_PAGES, DICT_BYTES = 200, 32 << 10


class WarcError(ValueError):
    """An archive that breaks the format."""


def _clean(x: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\r\n]+", " ", x).strip()


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_uri(page_id: int | None) -> str:
    """A page without an id has an empty one."""
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None = None, at: str = "1970-01-01T00:00:00Z") -> bytes:
    """The bytes of a response, or of a revisit where refers_to is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {page_uri(page_id)}", f"WARC-Date: {at}", f"WARC-Target-URI: {_clean(url)}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {page_uri(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> bytes:
    """A dictionary; empty where the samples are too few or too short for one."""
    if len(samples) < 8 or sum(map(len, samples)) < 16 * DICT_BYTES:
        return b""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


class Writer:
    """Collects records of one archive."""

    def __init__(self, dictionary: bytes = b"", level: int = 3) -> None:
        d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.parts, self.raw, self.records = [], 0, 0
        if dictionary:
            packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
            self.parts.append(struct.pack("<II", DICT_MAGIC, len(packed)) + packed)
        self.pack = zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=True, write_content_size=True).compress

    def add(self, rec: bytes) -> None:
        self.parts.append(self.pack(rec))
        self.raw += len(rec)
        self.records += 1

    def bytes(self) -> bytes:
        return b"".join(self.parts)


def frame_end(data: bytes, at: int) -> int:
    """Where the frame at a byte ends, by its block headers, so that no other byte of the archive is touched."""
    try:
        p = at + zstandard.frame_header_size(data[at : at + 18])
    except zstandard.ZstdError as e:
        raise WarcError(f"frame at byte {at}: {e}") from e
    while True:
        head = int.from_bytes(data[p : p + 3], "little")
        size = 1 if head >> 1 & 3 == 1 else head >> 3  # a run is one byte
        p += 3 + size
        if p > len(data):
            raise WarcError(f"the frame at byte {at} is cut off")
        if head & 1:
            break
    p += 4 * (data[at + 4] >> 2 & 1)  # the checksum
    if p > len(data):
        raise WarcError(f"the frame at byte {at} is cut off")
    return p


def frames(data: bytes) -> Iterator[bytes]:
    """The decoded frames of an archive, each checked by its checksum. The dictionary may itself be a frame."""
    at, d = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICT_MAGIC:
        n = struct.unpack_from("<I", data, 4)[0]
        raw = data[8 : 8 + n]
        if len(raw) != n:
            raise WarcError("the dictionary frame is cut off")
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):
            raw = zstandard.ZstdDecompressor().decompress(raw)
        d, at = zstandard.ZstdCompressionDict(raw), 8 + n
    z = zstandard.ZstdDecompressor(dict_data=d)
    while at < len(data):
        if at + 4 > len(data):
            raise WarcError("bytes after the last frame")
        magic = struct.unpack_from("<I", data, at)[0]
        if 0x184D2A50 <= magic <= 0x184D2A5F:  # other skippable frames
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        if magic != FRAME_MAGIC:
            raise WarcError(f"no frame at byte {at}")
        end = frame_end(data, at)
        o = z.decompressobj()
        try:
            out = o.decompress(data[at:end])
        except zstandard.ZstdError as e:
            raise WarcError(f"frame at byte {at}: {e}") from e
        if not o.eof or o.unused_data:
            raise WarcError(f"the frame at byte {at} is cut off")
        yield out
        at = end


NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")


def parse(rec: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block; the version, the needed headers, the length and the digests are checked."""
    head, sep, rest = rec.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise WarcError("no WARC version line")
    h: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"bad header {line!r}")
        h[name.strip().lower()] = value.strip()
    if missing := [n for n in NEEDED if n not in h]:
        raise WarcError(f"missing {', '.join(missing)}")
    if not h["content-length"].isdigit() or len(rest) != int(h["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("the block's length differs from Content-Length")
    block = rest[:-4]
    if "warc-block-digest" in h and h["warc-block-digest"] != f"sha1:{digest(block)}":
        raise WarcError("the block's digest differs")
    return h, block


def read_record(rec: bytes) -> dict:
    """page_id, url, payload (None of a revisit), payload_bytes, payload_digest, record_type, refers_to."""
    h, block = parse(rec)
    http, sep, body = block.partition(b"\r\n\r\n")
    length = re.search(rb"\r\ncontent-length: *(\d+)", http, re.I)
    if not sep or not length:
        raise WarcError("no HTTP head")
    n, told = int(length[1]), h["warc-payload-digest"].removeprefix("sha1:")
    ids = [re.fullmatch(r"<urn:page:(-?\d+)?>", h[k]) if k in h else None for k in ("warc-record-id", "warc-refers-to")]
    if h["warc-type"] == "response":
        if len(body) != n:
            raise WarcError("the payload's length differs from the HTTP head")
        if digest(body) != told:
            raise WarcError("the payload's digest differs")
    elif h["warc-type"] != "revisit" or body or not ids[1] or not ids[1][1]:
        raise WarcError("neither a response nor a sound revisit")
    if not ids[0]:
        raise WarcError("the record's id names no page")
    return {"page_id": None if ids[0][1] is None else int(ids[0][1]), "url": h.get("warc-target-uri", ""), "payload": body if h["warc-type"] == "response" else None, "payload_bytes": n, "payload_digest": told, "record_type": h["warc-type"], "refers_to": int(ids[1][1]) if ids[1] else None}


def plan_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages with the page that each row revisits, or null. A null page_id is larger than all others, and revisits nothing where its payload has no other.

    Only digests are grouped, with partial counts; of a payload that many pages
    share the rows meet a broadcast of the few such digests where they lie, so
    it makes no hot partition of html.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.withColumn("__d", F.sha1(html.cast("binary")))
    low = keyed.filter(F.octet_length(html) >= min_bytes).groupBy("__d").agg(F.min("page_id").alias("__low"), F.count("*").alias("__n")).filter("__n > 1")
    later = F.col("__low").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("__low")))
    return hot_join(keyed, low, "__d", "__n", "left").select("page_id", "url", "html", F.when(later, F.col("__low")).alias("refers_to"))


def write_archives(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, records, data) of pages (page_id, url, html). A row without a page_id has a record of an empty one."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    n = p.count()
    chosen = F.pmod(F.xxhash64("page_id"), F.lit(max(1, n // (4 * DICT_PAGES)))) == 0
    rows = p.filter(chosen & (F.octet_length("html") <= 65536)).select("html").limit(DICT_PAGES).collect()
    dictionary = train([r[0].encode() for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Writer(dictionary)

        def out(w: Writer) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([w.records], pa.int64()), pa.array([w.bytes()], pa.binary())], ["archive", "records", "data"])

        for b in batches:
            for page, url, html, to in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                w.add(record(page, url or "", (html or "").encode(), to))
                if w.raw >= archive_bytes:
                    yield out(w)
                    w = Writer(dictionary)
        if w.records:
            yield out(w)

    return map_batches(plan_revisits(p, min_bytes), run, "archive string, records long, data binary")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of archives (records, data), validated; a wrong number of records is an error."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payloads]
    types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = [read_record(f) for f in frames(data)]
                if len(found) != n:
                    raise WarcError(f"{len(found)} records of {n}")
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], types.get(k, pa.string())) for k in names], names)

    return map_batches(archives.select("records", "data"), run, ", ".join(f"{k} {'long' if types.get(k) == pa.int64() else 'binary' if k == 'payload' else 'string'}" for k in names))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload; empty payloads revisit like others.
    Repeated rows of a page are records each; with the smallest id all of them
    are responses. Rows without a page_id are kept, as revisits of the page
    with the smallest id that has their payload, else as responses. Payloads
    may be of any length, and other columns play no part.
    """
    return read_archives(materialize(write_archives(pages), "warc"), payloads=False).drop("url")


SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS low FROM p GROUP BY 1)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(d, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
CASE WHEN page_id = low OR low IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = low THEN NULL ELSE low END AS refers_to
FROM p JOIN f USING (d)"""
