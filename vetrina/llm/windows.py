"""Repeated fixed-length windows of token sequences, for the two substring
operators (35 words, 400 bytes).

Every window is assigned to one *anchor*: the smallest hashed gram inside
it (the leftmost, if tied).  Equal windows choose equal anchors at the same
place inside the window, so

* the number of occurrences of its anchor is never below the number of
  occurrences of a window, and
* all copies of a window meet when runs of windows are grouped by anchor.

1. Each partition counts its anchors in a **count-min sketch**; the
   partition sketches are sent sparsely, added up per block of cells, and
   only the bit "two or more" of each cell is kept (counters saturate at
   two, the only question asked).  The merged bitmap has a bounded size
   (``MAX_BITS``); an undersized sketch only lets more windows through.
2. Runs of windows whose anchor is estimated repeated become *segments*.
   Equal segments of a partition are merged with a count before the
   shuffle, then an exact second pass per anchor bucket decides which
   windows repeat.
   The windows of a *hot* anchor, one with many different segments, are
   dealt one by one by their own 128 bits of hash instead, so that no anchor
   fills a bucket.  Hot anchors are found with the sketch: a sample of
   segments, drawn by a hash of their ends, is counted per anchor.
3. The answer goes back by segment key to texts, and by text key to rows,
   so that copies of a text are examined once and each row gets its spans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetrina.llm.common import chars, materialize, pieces_for, text_key, whole_text

#: Cells per block of the sketch (one merge group each), rows of the sketch,
#: and its largest width: 2 x 2**29 bits are 128 MB in all, the bound of
#: what is broadcast.
BLOCK_BITS, DEPTH, MIN_BITS, MAX_BITS = 20, 2, 20, 29
#: Texts and segments that one task remembers for merging before the shuffle.
REMEMBERED = 200_000
#: Bytes of segments that one task merges at a time before the shuffle.
MERGED_BYTES = 8_000_000
#: One in so many different segments is sampled, an anchor with so many of the
#: sample is hot, and so many anchors are hot at most (32 MB broadcast).
SAMPLED, HOT, MAX_HOT = 256, 16, 1 << 22

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SALTS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_LOW32 = np.uint64(0xFFFFFFFF)


class Windows(NamedTuple):
    """What differs between the operators.

    ``tokens(text)`` gives a token sequence with a length, ``grams(tokens)``
    one 64-bit hash per gram of ``gram`` tokens.  Of segments, given as
    arrays of first windows and numbers of windows, ``seg_keys(tokens,
    start, n)`` gives two 64-bit hashes each and ``payload(tokens, start,
    n)`` the bytes, joined, and their sizes, from which ``find`` can compare
    the windows.  ``keys(tokens)`` gives two 64-bit hashes of every window.
    """

    window: int
    gram: int
    tokens: Callable
    grams: Callable
    seg_keys: Callable
    payload: Callable
    find: Callable
    keys: Callable


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def words64(b: np.ndarray, big: bool = False) -> np.ndarray:
    """The eight bytes at every position as one number (zeros past the end)."""
    padded = np.concatenate([b, np.zeros(8, np.uint8)])
    return np.ndarray(len(b), ">u8" if big else "<u8", padded.data, strides=(1,))


def sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive keys, in linear time: running
    minima from both ends of blocks of ``width``."""
    n = len(key)
    blocks = np.concatenate([key, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(spec: Windows, tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(first window, number of windows, anchor hash) of each run of windows
    with one anchor, and all gram hashes; None if the text has no window."""
    if len(tokens) < spec.window:
        return None
    h = spec.grams(tokens)
    at = (sliding_min(h & ~_LOW32 | np.arange(len(h), dtype=np.uint64), spec.window - spec.gram + 1) & _LOW32).astype(np.int64)
    start = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    return start, np.diff(np.append(start, len(at))), h[at[start]], h


# -- the sketch ---------------------------------------------------------

def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(h ^ _SALTS[row]) >> np.uint64(64 - bits)).astype(np.int64)


def _sparse(h: np.ndarray, bits: int) -> Iterator[dict]:
    """The touched cells of a partition sketch, per block: those counted
    once and those counted twice or more."""
    for row in range(DEPTH):
        cell, n = np.unique(_cells(h, row, bits), return_counts=True)
        block = cell >> BLOCK_BITS
        cut = np.flatnonzero(np.diff(block)) + 1
        for c, k in zip(np.split(cell, cut), np.split(n, cut), strict=True):
            if len(c):
                low = (c & ((1 << BLOCK_BITS) - 1)).astype(np.uint32)
                yield {"block": int((row << (bits - BLOCK_BITS)) + (c[0] >> BLOCK_BITS)), "once": low[k == 1].tobytes(), "more": low[k > 1].tobytes()}


def _merge_block(least: int):
    """Bitmaps of blocks; of sampled segments (negative blocks) the anchors
    with ``least`` different ones."""
    def merge(table: pa.Table) -> pa.Table:
        if table["block"][0].as_py() < 0:
            pairs = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64).reshape(-1, 2) for x in table["once"]]), axis=0)
            anchor, n = np.unique(pairs[:, 0], return_counts=True)
            return pa.table({"block": table["block"][:1], "bitmap": pa.array([anchor[n >= least].tobytes()], pa.binary())})
        count = np.zeros(1 << BLOCK_BITS, np.uint8)
        for once, more in zip(table["once"], table["more"], strict=True):
            at = np.frombuffer(once.as_buffer(), np.uint32)
            count[at] = np.minimum(count[at] + 1, 2)
            count[np.frombuffer(more.as_buffer(), np.uint32)] = 2
        return pa.table({"block": table["block"][:1], "bitmap": pa.array([np.packbits(count >= 2).tobytes()], pa.binary())})
    return merge


def _sample(spec: Windows, found) -> np.ndarray:
    """(anchor, hash of length and ends) of the sampled segments of a text."""
    start, n, anchor, h = found
    ends = mix(h[start] ^ mix(h[start + n - 1 + spec.window - spec.gram] + n.astype(np.uint64)))
    drawn = ends % np.uint64(SAMPLED) == 0
    return np.stack([anchor[drawn], ends[drawn]], 1)


def repeated_sketch(texts: DataFrame, spec: Windows, total: int):
    """Broadcast ``(bits, bitmap per row)`` of anchors counted twice or more,
    and the hot anchors in order."""
    expected = total * 2 / (spec.window - spec.gram + 2)
    shares = pieces_for(16 * expected / SAMPLED, 16e6)
    merge = _merge_block(max(HOT, int(expected / SAMPLED / MAX_HOT)))
    bits = int(min(MAX_BITS, max(MIN_BITS, np.ceil(np.log2(8 * expected + 1)))))

    def partial(batches):
        held: list[np.ndarray] = []
        drawn: list[np.ndarray] = []
        size = 0

        def flush():
            rows = list(_sparse(np.concatenate(held), bits)) if held else []
            pairs = np.concatenate(drawn) if drawn else np.zeros((0, 2), np.uint64)
            share = (pairs[:, 0] % np.uint64(shares)).astype(np.int64)
            rows += [{"block": -1 - int(k), "once": pairs[share == k].tobytes(), "more": b""} for k in np.unique(share)]
            return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("block", pa.int64()), ("once", pa.binary()), ("more", pa.binary())]))

        seen: dict = {}
        for batch in batches:
            for key, text in zip(batch.column("text_key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not _first_two(seen, key):
                    continue
                if (found := anchors(spec, spec.tokens(text))) is not None:
                    held.append(found[2])
                    drawn.append(_sample(spec, found))
                    size += len(found[2])
            if size >= 2_000_000:
                yield flush()
                held, drawn, size = [], [], 0
        yield flush()

    cells = texts.mapInArrow(partial, "block long, once binary, more binary")
    merged = cells.groupBy("block").applyInArrow(merge, "block long, bitmap binary")
    rows = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(DEPTH)]
    width = (1 << BLOCK_BITS) // 8
    hot = [np.zeros(0, np.uint64)]
    for block, bitmap in merged.toLocalIterator():
        if block < 0:
            hot.append(np.frombuffer(bytes(bitmap), np.uint64))
            continue
        row, place = divmod(block, 1 << (bits - BLOCK_BITS))
        rows[row][place * width : (place + 1) * width] = np.frombuffer(bytes(bitmap), np.uint8)
    return texts.sparkSession.sparkContext.broadcast((bits, rows, np.sort(np.concatenate(hot))))


def maybe_repeated(h: np.ndarray, sketch) -> np.ndarray:
    bits, rows, _ = sketch
    ok = np.ones(len(h), bool)
    for row, bitmap in enumerate(rows):
        cell = _cells(h, row, bits)
        ok &= (bitmap[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
    return ok


# -- segments, exact pass, answers --------------------------------------

def _first_two(seen: dict, key: bytes) -> bool:
    """Whether this text comes for the first or second time in this task: a
    third copy changes no decision (counts saturate at two)."""
    if len(seen) > REMEMBERED:
        seen.clear()
    n = seen[key] = seen.get(key, 0) + 1
    return n <= 2


def _segments(spec: Windows, tokens, sketch) -> tuple | None:
    """(first window, windows, anchor, key, whether dealt with a payload) of
    the runs estimated repeated, as arrays; under hot anchors each window is
    a segment by itself, without payload."""
    if (found := anchors(spec, tokens)) is None:
        return None
    start, n, anchor, _ = found
    keep = maybe_repeated(anchor, sketch)
    hot, alone = sketch[2], None
    if len(hot):
        many = keep & (hot[np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)] == anchor)
        if many.any():
            at = np.flatnonzero(np.repeat(many, n))  # the runs are all windows in order
            keys = spec.keys(tokens)[at]
            alone = at, np.ones(len(at), np.int64), keys[:, 0], keys, np.zeros(len(at), bool)
            keep &= ~many
    start, n, anchor = start[keep], n[keep], anchor[keep]
    runs = start, n, anchor, spec.seg_keys(tokens, start, n), np.ones(len(start), bool)
    return runs if alone is None else tuple(np.concatenate(x) for x in zip(runs, alone, strict=True))


def _binary(data, sizes: np.ndarray) -> pa.Array:
    """Binary values of the given sizes out of their joined bytes."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _joined(column) -> tuple[np.ndarray, np.ndarray]:
    """The joined bytes of a binary column without nulls, and where each
    value begins and the last ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def _keys_of(column) -> np.ndarray:
    return np.frombuffer(_joined(column)[0].tobytes(), np.uint64).reshape(-1, 2)


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, heads): rows of equal keys stand together in ``order``, each
    group begins at one of ``heads``, with its earliest row."""
    order = np.lexsort((key[:, 1], key[:, 0]))
    held = key[order]
    return order, np.flatnonzero(np.concatenate([[True], (held[1:] != held[:-1]).any(1)])) if len(key) else np.zeros(0, np.int64)


_SEGMENT = pa.schema([("bucket", pa.int32()), ("anchor", pa.int64()), ("seg_key", pa.binary()), ("windows", pa.int32()), ("weight", pa.int32()), ("payload", pa.binary())])


def _merged(held: pa.Table, found: list[tuple], buckets: int) -> pa.Table:
    """Held and newly found segments of a task, equal ones as one row with a
    count, at most two."""
    if found:
        n, anchor, key, size, data = zip(*found, strict=True)
        n, anchor, key, size = (np.concatenate(x) for x in (n, anchor, key, size))
        new = [(anchor % np.uint64(buckets)).astype(np.int32), anchor.view(np.int64), _binary(key.tobytes(), np.full(len(n), 16)),
               n.astype(np.int32), np.ones(len(n), np.int32), _binary(b"".join(data), size)]
        held = pa.concat_tables([held, pa.table([pa.array(c) for c in new], schema=_SEGMENT)])
    if not len(held):
        return held
    held = held.combine_chunks()
    order, heads = _groups(_keys_of(held["seg_key"]))
    weight = np.minimum(np.add.reduceat(held["weight"].to_numpy()[order], heads), 2)
    return held.take(pa.array(order[heads])).set_column(4, _SEGMENT.field(4), pa.array(weight.astype(np.int32)))


def repeated_spans(df: DataFrame, text_col: str, spec: Windows, bucket_mb: float, payload_per_char: float) -> DataFrame:
    """(text_key, spans array<struct<start, runs>>) of the texts that hold a
    repeated window.  ``runs`` is packed int32 pairs, first and last+1
    window, counted from ``start``."""
    texts = df.select(whole_text(text_col).alias("text")).select(text_key(F.col("text")).alias("text_key"), "text")
    total = chars(texts, "text")
    sketch = repeated_sketch(texts, spec, total)
    buckets = pieces_for(total * payload_per_char, bucket_mb * 1e6, 4)

    def payloads(batches):
        seen: dict = {}
        held, found, size = _SEGMENT.empty_table(), [], 0
        for batch in batches:
            for key, text in zip(batch.column("text_key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not _first_two(seen, key):
                    continue
                tokens = spec.tokens(text)
                if (segments := _segments(spec, tokens, sketch.value)) is None:
                    continue
                start, n, anchor, seg_key, own = segments
                data, each = spec.payload(tokens, start[own], n[own])
                sizes = np.zeros(len(start), np.int64)
                sizes[own] = each
                found.append((n, anchor, seg_key, sizes, data))
                size += len(data) + 64 * len(n)
                if size > MERGED_BYTES:  # what merging leaves above half is handed on
                    held, found = _merged(held, found, buckets), []
                    size = held.nbytes
                    if size > MERGED_BYTES // 2:
                        yield from held.combine_chunks().to_batches()
                        held, size = _SEGMENT.empty_table(), 0
        yield from _merged(held, found, buckets).combine_chunks().to_batches()

    def exact(table: pa.Table) -> pa.Table:
        order, heads = _groups(_keys_of(table["seg_key"]))
        weight = np.add.reduceat(table["weight"].to_numpy()[order].astype(np.int64), heads)
        table = table.take(pa.array(order[heads]))
        # equal windows have equal anchors: a segment that is alone with its
        # anchor repeats if it came twice, and need not be compared; nor need a
        # window that came by itself, its key is its hash
        _, of, alike = np.unique(table["anchor"].to_numpy(), return_inverse=True, return_counts=True)
        compared = (alike[of] > 1) & (pc.binary_length(table["payload"]).to_numpy() > 0)
        n = table["windows"].to_numpy().astype(np.int64)
        whole = np.flatnonzero(~compared & (weight > 1))
        whole_runs = np.stack([np.zeros(len(whole), np.int32), n[whole].astype(np.int32)], 1)
        rest = np.flatnonzero(compared)
        masks = spec.find(n[rest].tolist(), weight[rest].tolist(), table["payload"].take(pa.array(rest)).to_pylist()) if len(rest) else []
        pairs, each = _runs(masks)
        seg_key = table["seg_key"].take(pa.array(np.concatenate([whole, rest[each > 0]])))
        return pa.table({"seg_key": seg_key, "runs": _binary(whole_runs.tobytes() + pairs.tobytes(), np.concatenate([np.full(len(whole), 8), 8 * each[each > 0]]))})

    def places(batches):
        seen: set = set()
        for batch in batches:
            rows: list[tuple] = []
            for i, (key, text) in enumerate(zip(batch.column("text_key").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                if key in seen:
                    continue
                if len(seen) > REMEMBERED:
                    seen.clear()
                seen.add(key)
                if (found := _segments(spec, spec.tokens(text), sketch.value)) is not None:
                    rows.append((np.full(len(found[0]), i), found[0], found[3]))
            if rows:
                of, start, seg_key = (np.concatenate(x) for x in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("text_key").take(pa.array(of)), pa.array(start.astype(np.int32)),
                                                  _binary(seg_key.tobytes(), np.full(len(of), 16))], ["text_key", "start", "seg_key"])

    answers = (texts.mapInArrow(payloads, "bucket int, anchor long, seg_key binary, windows int, weight int, payload binary")
               .groupBy("bucket").applyInArrow(exact, "seg_key binary, runs binary"))
    # the answers are small; written, they cut the lineage of the long pass
    answers = materialize(answers, "repeated-segments")
    found = texts.mapInArrow(places, "text_key binary, start int, seg_key binary").join(answers, "seg_key").select("text_key", "start", "runs").distinct()
    return found.groupBy("text_key").agg(F.collect_list(F.struct("start", "runs")).alias("spans"))


def _runs(masks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(first, last + 1) of the runs of all masks, and how many each mask has."""
    if not masks:
        return np.zeros((0, 2), np.int32), np.zeros(0, np.int64)
    size = np.array([len(m) + 1 for m in masks])
    begin = np.cumsum(size) - size
    flat = np.zeros(int(size.sum()) + 1, np.int8)  # a zero between masks
    flat[np.arange(len(flat) - 1 - len(masks)) + np.repeat(np.arange(len(masks)) + 1, size - 1)] = np.concatenate(masks)
    edge = np.flatnonzero(np.diff(flat)).reshape(-1, 2)
    of = np.searchsorted(begin, edge[:, 0], side="right") - 1
    return (edge - begin[of, None]).astype(np.int32), np.bincount(of, minlength=len(masks))


def span_runs(column) -> Iterator[np.ndarray]:
    """Per row of a ``spans`` column the repeated (first, last + 1) windows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data, at = _joined(column.flatten().field("runs"))
    pairs = np.frombuffer(data.tobytes(), np.int32).reshape(-1, 2).astype(np.int64)
    pairs += np.repeat(column.flatten().field("start").to_numpy().astype(np.int64), np.diff(at) // 8)[:, None]
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    last = (at[np.concatenate([[0], ends])] // 8).tolist()
    for a, b in zip(last, last[1:], strict=False):
        yield pairs[a:b]


def covered_by(n_tokens: int, runs: np.ndarray, window: int) -> np.ndarray:
    """Mask of the tokens that some window of the given runs covers."""
    if not len(runs):
        return np.zeros(n_tokens, bool)
    step = np.bincount(runs[:, 0], minlength=n_tokens + 1) - np.bincount(runs[:, 1] - 1 + window, minlength=n_tokens + 1)
    return np.cumsum(step[:-1]) > 0


def covered(n_tokens: int, spans, window: int) -> np.ndarray:
    """Mask of the tokens that some repeated window covers."""
    runs = [np.frombuffer(bytes(span["runs"]), np.int32).reshape(-1, 2).astype(np.int64) + span["start"] for span in spans or ()]
    return covered_by(n_tokens, np.concatenate(runs) if runs else np.zeros((0, 2), np.int64), window)


def with_spans(df: DataFrame, id_col: str, text_col: str, spans: DataFrame) -> DataFrame:
    """(id, text, spans) of every row; spans is null where nothing repeats."""
    rows = df.select(F.col(f"`{id_col}`").alias("row_id"), whole_text(text_col).alias("text"))
    return rows.withColumn("text_key", text_key(F.col("text"))).join(spans, "text_key", "left").select("row_id", "text", "spans")
