"""Operator 9, exact substring dedup by suffix arrays over UTF-8 bytes.

Spark deals runs of 400-byte windows to buckets so that equal windows meet
(``windows.py``).  In each bucket a suffix array of the distinct segments is
built by two-stage sorting: only suffixes smaller than their successor are
sorted directly, the rest is induced by scanning the buckets of first bytes
in order; then the common prefixes of neighbours in the array tell which
windows are equal.

Windows of a hot anchor (see ``windows.py``) are compared by 128 bits of hash.

Order and common prefixes are followed to ``length`` bytes only: longer
agreement changes no decision.

Defined cases: null counts as empty; a text shorter than ``length`` loses
nothing; copies of a row count as occurrences, so copies of a long text lose
every byte; removal may cut a multi-byte character, so what is kept is
binary; an empty table gives an empty result; other columns are neither read
nor returned.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from vetrina.llm.substring_dedup import window_hashes
from vetrina.llm.windows import Windows, covered_by, mix, repeated_spans, span_runs, with_spans, words64

LENGTH, GRAM = 400, 16
_C = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _grams(b: np.ndarray) -> np.ndarray:
    w = words64(b)
    n = len(b) - GRAM + 1
    return mix(w[:n] * _C[0] ^ (w[8 : 8 + n] + _C[1]) * _C[1])


def _tokens(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def _seg_keys(length: int):
    def seg_keys(b, start, n):
        data = b.tobytes()
        digests = [xxhash.xxh3_128_digest(data[s:e]) for s, e in zip(start.tolist(), (start + n + length - 1).tolist(), strict=True)]
        return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    return seg_keys


def _payload(length: int):
    def payload(b, start, n):
        data = b.tobytes()
        return b"".join([data[s:e] for s, e in zip(start.tolist(), (start + n + length - 1).tolist(), strict=True)]), n + length - 1
    return payload


def suffix_order(s: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Suffix array of the bytes ``s`` by two-stage sorting, exact to
    ``depth`` bytes (suffixes that agree further may stand in any order).
    With a mask ``wanted``, of the suffixes in it and those from which
    their order is induced."""
    n = len(s)
    if n == 0:
        return np.zeros(0, np.int64)
    # larger[i]: suffix i is larger than suffix i + 1 (the empty suffix is
    # smallest); in a run of one byte, as at the run's end
    ahead = np.append(s[1:], 0).astype(np.int16)
    differ = s != ahead
    differ[-1] = True
    falls = s > ahead
    falls[-1] = True
    at = np.flatnonzero(differ)
    larger = falls[at[np.searchsorted(at, np.arange(n))]]

    # a larger suffix takes its place from its successor, and so on to the
    # first small one; no other suffix bears on the order of the wanted ones
    if wanted is not None:
        ends = np.append(np.flatnonzero(~larger), n)
        from_ = np.flatnonzero(wanted & larger)
        step = np.bincount(from_, minlength=n + 2) - np.bincount(ends[np.searchsorted(ends, from_)] + 1, minlength=n + 2)
        used = wanted | (np.cumsum(step)[:n] > 0)
        larger &= used
    else:
        used = np.ones(n, bool)

    # stage one: sort the suffixes smaller than their successor
    small = np.flatnonzero(used & ~larger)
    key = words64(s, big=True)[small]
    order = np.argsort(key, kind="stable")
    small, key = small[order], key[order]
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(small) else np.zeros(1, np.int64)
    tied = np.flatnonzero(np.diff(cut) > 1)
    data = s.tobytes()
    for a, b in zip(cut[tied].tolist(), cut[tied + 1].tolist(), strict=True):
        small[a:b] = sorted(small[a:b].tolist(), key=lambda i: data[i + 8 : i + depth])

    # stage two: in the bucket of a first byte the larger ones come first
    total, n_larger = np.bincount(s[used], minlength=256), np.bincount(s[larger], minlength=256)
    begin = np.concatenate([[0], np.cumsum(total)[:-1]])
    out = np.empty(int(total.sum()), np.int64)
    first_small = np.concatenate([[0], np.cumsum(total - n_larger)])
    for c in np.flatnonzero(total - n_larger):
        out[begin[c] + n_larger[c] : begin[c] + total[c]] = small[first_small[c] : first_small[c + 1]]
    free = begin.copy()

    def induce(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[larger[before]]
        if len(before):
            byte = s[before]
            place = np.argsort(byte, kind="stable")
            before, byte = before[place], byte[place]
            head = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
            size = np.diff(np.append(head, len(byte)))
            out[np.repeat(free[byte[head]] - head, size) + np.arange(len(byte))] = before
            free[byte[head]] += size

    induce(np.array([n]))
    for c in np.flatnonzero(total):
        done = begin[c]
        while done < free[c]:  # also what this bucket induces into itself
            upto = free[c]
            induce(out[done:upto])
            done = upto
        induce(out[begin[c] + n_larger[c] : begin[c] + total[c]])
    return out


def common_prefixes(s: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of neighbours in the suffix array, counted to ``depth``
    (in whole steps of eight bytes until they differ, then bytes)."""
    lcp = np.zeros(max(len(order) - 1, 0), np.int64)
    padded = np.concatenate([s, np.zeros(depth + 8, np.uint8)])
    w = np.ndarray(len(s) + depth, "<u8", padded.data, strides=(1,))
    live = np.arange(len(lcp))
    for off in range(0, depth, 8):
        if not len(live):
            break
        d = w[order[live] + off] ^ w[order[live + 1] + off]
        same = d == 0
        ended = d[~same]
        lcp[live[~same]] = off + (np.bitwise_count((ended & (~ended + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3)
        live = live[same]
    lcp[live] = depth
    room = len(s) - np.maximum(order[1:], order[:-1]) if len(lcp) else lcp
    return np.minimum(np.minimum(lcp, depth), room)


def _find(length: int):
    def find(n: list[int], weight: list[int], payload: list[bytes]):
        # UTF-8 has no byte 0xFF, so one more than a byte leaves 0 as separator
        s = np.concatenate([np.append(np.frombuffer(p, np.uint8) + np.uint8(1), np.uint8(0)) for p in payload])
        size = np.array([len(p) + 1 for p in payload])
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        owner = np.repeat(np.arange(len(n)), size)
        starts = (np.arange(len(s)) - begin[owner]) < np.asarray(n)[owner]
        order = suffix_order(s, length, starts)
        # equal windows stand together, with no other suffix between them
        order = order[starts[order]]
        same = common_prefixes(s, order, length) >= length
        repeated = np.zeros(len(s), bool)
        repeated[order[1:][same]] = True
        repeated[order[:-1][same]] = True
        repeated |= starts & (np.asarray(weight)[owner] >= 2)
        return [repeated[b : b + k] for b, k in zip(begin.tolist(), n, strict=True)]
    return find


def spec_of(length: int = LENGTH) -> Windows:
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM}")
    return Windows(length, GRAM, _tokens, _grams, _seg_keys(length), _payload(length), _find(length), lambda b: window_hashes(mix(b + _C[0]), length))


def remove_repeated_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans (maximal removed runs), kept
    (binary) and kept_sha256.  See the module docstring for defined cases."""
    # a run of about (length - 16) / 2 windows ships its length - 1 more bytes
    spans = repeated_spans(df, text_col, spec_of(length), bucket_mb=4, payload_per_char=3.3)
    id_type = df.schema[id_col].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            kept, n_bytes, n_removed, n_spans = [], [], [], []
            for text, runs in zip(batch.column("text").to_pylist(), span_runs(batch.column("spans")), strict=True):
                b = _tokens(text)
                gone = covered_by(len(b), runs, length)
                kept.append(b[~gone].tobytes())
                n_bytes.append(len(b))
                n_removed.append(int(gone.sum()))
                n_spans.append(int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), *(pa.array(c, pa.int64()) for c in (n_bytes, n_removed, n_spans)),
                 pa.array(kept, pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
                ["row_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return (with_spans(df, id_col, text_col, spans)
            .mapInArrow(cut, f"row_id {id_type}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
            .withColumnRenamed("row_id", id_col))
