"""Operator 13, secrets behind any number of encodings.

A worklist of layers starts with the text.  Each layer is scanned with the
base patterns, then unwrapped: URL escapes and Unicode escapes give the layer
with all of them replaced, each base64 run gives its bytes, compressed data
(gzip, zlib, bzip2, xz, zstandard) in a decoded layer gives what it holds.
Every new layer goes on the list, until none is left.  Layers are remembered
by content and by the part of the text they came from, so an encoding that
unwraps to itself ends.  A layer knows how its characters map to the layer
above it, so whatever is found becomes a span of the text: to the character
for escapes and base64, the whole run for compressed data.

Layers are bytes, one for each character: the text has its code points beyond
ASCII replaced by ``?``, which no pattern reads, so offsets are code points.
Base64 is decoded in the four alignments of its run (line breaks after 64 or
76 characters are joined), so a run that follows a path or a word is found.

Rows are independent: one pass, no shuffle.  Against decompression bombs the
layers of one text may hold ``max_bytes`` plus eight times the text together;
``n_unopened`` counts the layers cut or left closed for that.  The text and
its base spans are always whole.

Defined cases: a null text counts as empty; an empty text has no spans; rows
that share an id are rows of their own; an empty table gives an empty result;
of the input columns, those named like a result column are replaced, all
others are returned.  Spans are code points, end exclusive, sorted by start,
then kind as listed, then end; one found in several layers is given once.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import io
import lzma
import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vetrina.llm.common import by_bytes, whole_text

KINDS = ("assign", "access", "hex")
RESULT = ("base", "spans", "n_layers", "n_unopened")
MAX_BYTES = 1 << 26

_ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{14,}")
_WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")  # an assignment holds one of them
_URL = re.compile(rb"%([0-9A-Fa-f]{2})")
_UNICODE = re.compile(rb"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});|([\x01-\x7f])\x00")
_MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
#: What a decoded run must hold to become a layer.
_WORTH = re.compile(rb"(?i:passw|secret|token|api_?key)|AKIA[A-Z0-9]{14}|[0-9a-f]{16}|%[0-9A-Fa-f]{2}|\\[uUx]|&#|(?:[\x01-\x7f]\x00){4}|[A-Za-z0-9+/_-]{16}|" + _MAGIC.pattern)


def _members(alphabet: bytes) -> bytes:
    return bytes(ord("m") if c in alphabet else ord(" ") for c in range(256))


_HEX_RUN = _members(b"0123456789abcdef")
_B64_RUN = _members(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_")
_STANDARD = bytes.maketrans(b"-_", b"+/")


def _runs(data: bytes, table: bytes, least: int = 16) -> Iterator[tuple[int, int]]:
    """Maximal runs of an alphabet, of ``least`` characters or more."""
    marks, whole = data.translate(table), b"m" * least
    begin = marks.find(whole)
    while begin >= 0:
        end = marks.find(b" ", begin + least)
        end = len(marks) if end < 0 else end
        yield begin, end
        begin = marks.find(whole, end)


def base_spans(data: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns in one layer."""
    found = [(a, 2, b) for a, b in _runs(data, _HEX_RUN)]
    if b"AKIA" in data:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(data)]
    low = data.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(data) if m.end(2) - m.start(2) >= 12]
    return sorted(found)


Place = Callable[[int, int], tuple[int, int]]


class Layer:
    """Bytes and the way back: ``place`` maps a span to the layer above."""

    def __init__(self, data: bytes, above: Layer | None = None, place: Place | None = None, raw: bool = False):
        self.data, self.above, self.place, self.raw = data, above, place, raw

    def origin(self, a: int, b: int) -> tuple[int, int]:
        """The span of the text that a span of this layer came from."""
        layer = self
        while layer.above is not None:
            a, b = layer.place(a, b)
            layer = layer.above
        return a, b


def _code(m: re.Match) -> bytes:
    if m.re is _URL:
        return bytes([int(m[1], 16)])
    group = m.lastindex
    point = m[7][0] if group == 7 else int(m[group], 10 if group == 6 else 16)
    return bytes([point]) if point < 256 else b"?"


def _escapes(layer: Layer, pattern: re.Pattern) -> Layer | None:
    """The layer with every escape of one sort replaced."""
    out, at, size = [], 0, 0
    own, begins, ends = [], [], []  # of each escape: place in the new layer, span in this one
    for m in pattern.finditer(layer.data):
        plain = layer.data[at : m.start()]
        own.append(size + len(plain))
        begins.append(m.start())
        ends.append(m.end())
        out += (plain, _code(m))
        at, size = m.end(), own[-1] + 1
    if not own:
        return None

    def edge(k: int, escape: list[int], last: int) -> int:
        i = bisect_right(own, k) - 1
        if i < 0:
            return k + last
        return escape[i] if own[i] == k else ends[i] + k - own[i] - 1 + last

    return Layer(b"".join((*out, layer.data[at:])), layer, lambda a, b: (edge(a, begins, 0), edge(b - 1, ends, 1)), layer.raw)


def _wrapped(data: bytes) -> Iterator[tuple[bytes, Callable[[int], int]]]:
    """Base64 runs, lines of 64 or 76 joined, with the place of each
    character in the layer."""
    group: list[tuple[int, int]] = []

    def whole():
        text = b"".join(data[a:b] for a, b in group)
        if len(group) == 1:
            first = group[0][0]
            return text, lambda k: first + k
        places = np.concatenate([np.arange(a, b) for a, b in group])
        return text, lambda k: int(places[k])

    for a, b in _runs(data, _B64_RUN, 1) if b"\n" in data and _lines(data) else _runs(data, _B64_RUN):
        if group and data[group[-1][1] : a] in (b"\n", b"\r\n") and group[-1][1] - group[-1][0] in (64, 76):
            group.append((a, b))
            continue
        if group and sum(e - s for s, e in group) >= 16:
            yield whole()
        group = [(a, b)]
    if group and sum(e - s for s, e in group) >= 16:
        yield whole()


_LINE = re.compile(rb"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{64}|[A-Za-z0-9+/_-]{76})\r?\n")


def _lines(data: bytes) -> bool:
    return b"m" * 64 in data.translate(_B64_RUN) and _LINE.search(data) is not None


def _base64(layer: Layer) -> Iterator[Layer]:
    for run, place in _wrapped(layer.data):
        run = run.translate(_STANDARD)
        for skip in range(4):
            n = len(run) - skip
            n -= n % 4 == 1
            if n < 12:
                continue
            data = binascii.a2b_base64(run[skip : skip + n] + b"=" * (-n % 4))
            if _WORTH.search(data):
                yield Layer(data, layer, lambda a, b, skip=skip, place=place: (place(skip + a * 8 // 6), place(skip + (b * 8 - 1) // 6) + 1), True)


def _unpack(data: bytes, most: int, sure: bool) -> tuple[bytes, int]:
    """What compressed data holds, at most so many bytes, and the size of its
    compressed form.  A stream that breaks off counts only where its header
    is ``sure``, not two bytes that may occur by chance."""
    if data[:4] == b"\x28\xb5\x2f\xfd":
        with zstandard.ZstdDecompressor(max_window_size=1 << 27).stream_reader(io.BytesIO(data)) as stream:
            return stream.read(most), len(data)
    if data[:3] == b"BZh":
        unpack = bz2.BZ2Decompressor()
    elif data[:2] == b"\xfd7":
        unpack = lzma.LZMADecompressor(memlimit=1 << 27)
    else:
        unpack = zlib.decompressobj(47)  # gzip or zlib by its header
    out = unpack.decompress(data, most)
    ended = unpack.eof or len(out) >= most
    return out if ended or sure else b"", len(data) - len(unpack.unused_data)


def _compressed(layer: Layer, room: Callable[[], int]) -> Iterator[tuple[Layer, bool]]:
    """The compressed data in a layer, and whether each was cut."""
    at = 0
    while (m := _MAGIC.search(layer.data, at)) is not None:
        at, begin = m.start() + 1, m.start()
        most = room()
        try:
            data, size = _unpack(layer.data[begin:], max(most, 1), begin == 0 or len(m[0]) > 2)
        except (OSError, EOFError, ValueError, MemoryError, zlib.error, lzma.LZMAError, zstandard.ZstdError):
            continue
        if data:
            at = begin + size
            yield Layer(data, layer, lambda a, b, s=begin, e=begin + size: (s, e), True), len(data) >= most


def scan(text: str, max_bytes: int = MAX_BYTES):
    """(base spans, all spans, layers unwrapped, layers cut or left closed)
    of one text; spans are (start, kind, end)."""
    top = Layer(text.encode("ascii", "replace"))
    base = base_spans(top.data)
    room = max_bytes + 8 * len(top.data)
    spans, seen, todo = set(base), {(hashlib.sha256(top.data).digest(), 0, len(top.data))}, deque([top])
    layers = unopened = 0

    def push(layer: Layer | None) -> None:
        nonlocal layers, unopened, room
        if layer is None or not layer.data:
            return
        mark = (hashlib.sha256(layer.data).digest(), *layer.origin(0, len(layer.data)))
        if mark in seen:
            return
        if len(layer.data) > room:
            unopened += 1
            return
        seen.add(mark)
        room, layers = room - len(layer.data), layers + 1
        todo.append(layer)

    while todo:
        layer = todo.popleft()
        if layer is not top:
            spans.update((start, kind, end) for (a, kind, b) in base_spans(layer.data) for start, end in [layer.origin(a, b)])
        if b"%" in layer.data:
            push(_escapes(layer, _URL))
        if b"\\" in layer.data or b"&#" in layer.data or layer.raw and b"\x00" in layer.data:
            push(_escapes(layer, _UNICODE))
        for inner in _base64(layer):
            push(inner)
        if layer.raw:
            for inner, cut in _compressed(layer, lambda: room):
                unopened += cut
                push(inner)
    return base, sorted(spans), layers, unopened


def scan_secrets(df: DataFrame, text_col: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """Input rows with base and spans (arrays of kind, start, end), n_layers
    and n_unopened."""
    own = [c for c in df.columns if c not in RESULT]
    rows = df.select(*[F.col(f"`{c}`").alias(f"s13_{i}") for i, c in enumerate(own)], whole_text(text_col).alias("s13_text"))
    held = rows.schema[: len(own)]
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    types = [T.ArrayType(span), T.ArrayType(span), T.LongType(), T.LongType()]
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in by_bytes(batches, "s13_text"):
            found = [scan(t, max_bytes) for t in batch.column("s13_text").to_pylist()]
            spans = [pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in f[i]] for f in found], arrow) for i in (0, 1)]
            counts = [pa.array([f[i] for f in found], pa.int64()) for i in (2, 3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in held), *spans, *counts], [*(f.name for f in held), *RESULT])

    out = rows.mapInArrow(run, T.StructType([*held, *(T.StructField(c, t) for c, t in zip(RESULT, types))]))
    return out.select(*[F.col(f"s13_{i}").alias(c) for i, c in enumerate(own)], *RESULT)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
