"""Operator 3, WARC archives as seekable Zstandard bundles.

A bundle is a complete file image: independent Zstandard frames, each
holding a group of whole WARC/1.1 records, then a seek table in a skippable
frame with a fixed footer.  The index maps each record identifier to its
frame and the offset inside the decompressed frame, so one record is read by
decompressing one frame.  Bundles are rows of a table (``bundle_id``,
``data``, ``index``), which any store that Spark reaches can hold.

Payload rule: of records with equal payloads of at least ``least`` bytes the
one with the largest id is a ``response``; the others are ``revisit``
records that refer to it and carry no payload.  Smaller payloads are all
responses.

Defined cases: a null payload is empty; a null id sorts before all others
and its record has no page header (read back as null); of repeated rows with
the largest id one is the response and the others refer to that same id; a
null url gives a record without target; line breaks in urls are
percent-encoded; an empty table gives no bundles; other columns are not
read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the seekable format: the magic number of a skippable
# frame, the one of the seek table's footer, and the layout of an entry
# (compressed size, size, checksum) and of the footer (frames, descriptor
# with the checksum flag, magic number).
SKIPPABLE, SEEKABLE, ENTRY, FOOTER = 0x184D2A5E, 0x8F92EAB1, "<III", "<IBI"
CHECKSUMS = 0x80

FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 1 << 24
_URN = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace
_DATE = "2000-01-01T00:00:00Z"


# -- records ------------------------------------------------------------

def record_id(page_id: int | None, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_URN, f'page/{page_id}/{copy}')}>"


def write_record(rid: str, page_id, url, payload: bytes, digest: str, refers_to, size: int | None = None) -> bytes:
    """One WARC/1.1 record; a revisit (``refers_to`` given) has no payload, only
    its ``size`` (that of ``payload`` if not given)."""
    revisit = refers_to is not None
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", rid), ("WARC-Date", _DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url)))
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", len(payload) if size is None else size)]
    if page_id is not None:
        head.append(("X-Page-ID", page_id))
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To", record_id(refers_to, 0)), ("X-Refers-To-Page", refers_to)]
    body = b"" if revisit else payload
    head += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(body))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + body + b"\r\n\r\n"


def read_record(data: bytes, offset: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, body, offset of the next record) of the record at offset."""
    end = data.index(b"\r\n\r\n", offset)
    version, *lines = data[offset:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record at offset {offset}")
    head = dict(line.split(": ", 1) for line in lines)
    size = int(head["Content-Length"])
    body = data[end + 4 : end + 4 + size]
    if len(body) < size:
        raise ValueError(f"truncated WARC record at offset {offset}")
    return head, body, end + 4 + size + 4


# -- bundles ------------------------------------------------------------

class BundleWriter:
    """Groups records into frames; ``finish`` appends the seek table."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self._limit, self._zstd = frame_bytes, zstandard.ZstdCompressor(level=3)
        self._frame, self._held, self.size = [], 0, 0
        self._frames: list[bytes] = []
        self._table: list[bytes] = []
        self.index: list[tuple[str, int, int]] = []

    def add(self, rid: str, record: bytes) -> None:
        self.index.append((rid, len(self._frames), self._held))
        self._frame.append(record)
        self._held += len(record)
        if self._held >= self._limit:
            self._close()

    def _close(self) -> None:
        if self._frame:
            raw = b"".join(self._frame)
            packed = self._zstd.compress(raw)
            self._frames.append(packed)
            self._table.append(struct.pack(ENTRY, len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.size += len(packed)
            self._frame, self._held = [], 0

    def finish(self) -> bytes:
        self._close()
        table = b"".join(self._table) + struct.pack(FOOTER, len(self._table), CHECKSUMS, SEEKABLE)
        return b"".join(self._frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


class BundleReader:
    """Random access to the frames of a bundle by its seek table."""

    def __init__(self, data: bytes):
        n, flags, magic = struct.unpack(FOOTER, data[-9:])
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        self._data, self._zstd, self.frames, at = data, zstandard.ZstdDecompressor(), [], 0
        width = 12 if flags & CHECKSUMS else 8
        table = len(data) - 9 - n * width
        for i in range(n):
            packed, size = struct.unpack_from("<II", data, table + i * width)
            check = struct.unpack_from("<I", data, table + i * width + 8)[0] if width == 12 else None
            self.frames.append((at, packed, size, check))
            at += packed

    def frame(self, i: int) -> bytes:
        at, packed, size, check = self.frames[i]
        raw = self._zstd.decompress(self._data[at : at + packed], max_output_size=max(size, 1))
        if check is not None and xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} is damaged")
        return raw

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        for i in range(len(self.frames)):
            raw, at = self.frame(i), 0
            while at < len(raw):
                head, body, at = read_record(raw, at)
                yield head, body

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        return read_record(self.frame(frame), offset)[:2]


# -- on Spark -----------------------------------------------------------

def with_revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int = 1000) -> DataFrame:
    """(page_id, url, payload, size, digest, copy, refers_to): what to write.

    Small payloads are written where they are read.  A large one is shuffled
    once, with the row of its response; revisits need its size and digest
    only, so theirs (``payload`` null) travel without it."""
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    large = rows.where(F.col("size") >= least)
    # of repeated rows with the largest id, the one with the largest url is the response
    top = large.groupBy("digest", "size").agg(F.max_by(F.struct("page_id", "url", "payload"), F.struct("page_id", "url")).alias("r"))
    responses = rows.where(F.col("size") < least).select("page_id", "url", "payload", "size", "digest").unionByName(top.select("r.page_id", "r.url", "r.payload", "size", "digest"))
    # one small row per large payload; only payloads that occur twice matter
    first = large.groupBy("digest", "size").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    twins = large.drop("payload").join(first, ["digest", "size"])
    is_top = F.col("page_id").eqNullSafe(F.col("response"))
    place = Window.partitionBy("digest", "size", "page_id").orderBy(F.col("url").desc())
    again = twins.where(is_top).withColumn("copy", F.row_number().over(place) - 1).where("copy > 0")
    revisits = twins.where(~is_top).withColumn("copy", F.lit(0)).unionByName(again)
    names = ["page_id", "url", "payload", "size", "digest", "copy", "refers_to"]
    return responses.withColumns({"copy": F.lit(0), "refers_to": F.lit(None).cast("long")}).select(*names).unionByName(
        revisits.withColumns({"payload": F.lit(None).cast("binary"), "refers_to": F.col("response")}).select(*names))


def write_bundles(records: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """(bundle_id, data, index array<struct<record_id, frame, offset>>)."""

    def pack(batches):
        from pyspark import TaskContext
        part, n, out = TaskContext.get().partitionId(), 0, BundleWriter(frame_bytes)

        def row():
            data = out.finish()
            return pd.DataFrame({"bundle_id": [f"{part:06d}-{n:06d}"], "data": [data], "index": [[{"record_id": r, "frame": f, "offset": o} for r, f, o in out.index]]})

        for batch in batches:
            whole = lambda c: [None if pd.isna(x) else int(x) for x in batch[c]]
            for page, url, payload, size, digest, copy, refers in zip(whole("page_id"), batch["url"], batch["payload"], whole("size"), batch["digest"], batch["copy"], whole("refers_to"), strict=True):
                rid = record_id(page, int(copy))
                out.add(rid, write_record(rid, page, url, bytes(payload or b""), digest, refers, size))
                if out.size >= bundle_bytes:
                    yield row()
                    n, out = n + 1, BundleWriter(frame_bytes)
        if out.index:
            yield row()

    return records.mapInPandas(pack, "bundle_id string, data binary, index array<struct<record_id: string, frame: int, offset: long>>")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Every record of the bundles, read back: page_id, payload_bytes,
    payload_digest, record_type, refers_to, record_id, url.  Lengths and
    digests of responses are taken from the payload that was read."""

    def unpack(batches):
        for batch in batches:
            for data in batch["data"]:
                rows = []
                for head, body in BundleReader(bytes(data)).records():
                    response = head["WARC-Type"] == "response"
                    digest = hashlib.sha1(body).hexdigest() if response else head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Payload-Digest"] != f"sha1:{digest}":
                        raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")
                    number = lambda k: int(head[k]) if k in head else None
                    rows.append((number("X-Page-ID"), len(body) if response else number("X-Payload-Length"), digest,
                                 head["WARC-Type"], number("X-Refers-To-Page"), head["WARC-Record-ID"], head.get("WARC-Target-URI")))
                frame = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url"])
                yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})

    return bundles.select("data").mapInPandas(
        unpack, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string")
