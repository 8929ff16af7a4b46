"""Operator 4, substring dedup with a count-min prefilter.

Windows of ``window`` consecutive words are counted in merged partition
sketches, which never underestimate; only windows estimated repeated take
part in the exact second pass (see ``windows.py``).  A window is compared by
128 bits of hash over its words.

Defined cases: a null or empty text has no words and nothing removed; a text
shorter than a window loses nothing; equal rows each count as an occurrence,
so copies of a text of at least one window lose all words; rows with one id
are treated as separate rows; an empty table gives an empty result; other
columns are neither read nor returned, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from vetrina.llm.windows import Windows, covered_by, mix, repeated_spans, span_runs, with_spans, words64

WINDOW, GRAM = 35, 8
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
#: Words of 64-bit hash that a worker remembers.
WORDS_KEPT = 300_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def words(text: str) -> list[bytes]:
    """Maximal runs of characters other than space and \\x09-\\x0D: just
    what ``bytes.split()`` separates at."""
    return text.encode("utf-8", "surrogatepass").split()


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))


_SEPARATES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def text_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each of ``words(text)``: of up to 16 bytes read at
    once, of longer words one by one."""
    data = text.encode("utf-8", "surrogatepass")
    b = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], ~_SEPARATES[b], [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    n, at = end - start, words64(np.append(b, np.zeros(8, np.uint8)))
    low = at[start] & _FIRST[np.minimum(n, 8)]
    high = at[np.minimum(start + 8, len(b))] & _FIRST[np.clip(n - 8, 0, 8)]
    h = mix(low ^ mix(high + n.astype(np.uint64) * np.uint64(_BASES[0])))
    for i in np.flatnonzero(n > 16).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]])
    return h


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 4096)
        inverse = pow(base, -1, 1 << 64)
        have = _POWERS[base] = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (base, inverse))
    return have


def window_hashes(h: np.ndarray, window: int) -> np.ndarray:
    """Two polynomial hashes of every window (columns), by prefix sums."""
    n, out = len(h), []
    for row, base in enumerate(_BASES):
        w = h if row == 0 else mix(h ^ np.uint64(base))
        up, down = _powers(base, n + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(w * up[:n])])
        out.append((sums[window:] - sums[:-window]) * down[: n - window + 1])
    return np.stack(out, 1)


def _grams(h: np.ndarray, gram: int) -> np.ndarray:
    base, out = np.uint64(_BASES[0]), np.zeros(len(h) - gram + 1, np.uint64)
    for j in range(gram):
        out = out * base + h[j : len(h) - gram + 1 + j]
    return mix(out)


def _seg_keys(window: int):
    def seg_keys(h, start, n):
        """Two polynomial hashes of all words of each segment."""
        out, end = [], start + n + window - 1
        for row, base in enumerate(_BASES):
            up, down = _powers(base, len(h) + 1)
            sums = np.concatenate([[np.uint64(0)], np.cumsum((h if row == 0 else mix(h ^ np.uint64(base))) * up[: len(h)])])
            out.append(mix((sums[end] - sums[start]) * down[start] + n.astype(np.uint64)))
        return np.stack(out, 1)
    return seg_keys


def _payload(window: int):
    def payload(h, start, n):
        at = np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)
        return window_hashes(h, window)[at].tobytes(), 16 * n
    return payload


def _find(n: list[int], weight: list[int], payload: list[bytes]):
    """Exact grouping of the windows of one bucket."""
    h = np.frombuffer(b"".join(payload), np.uint64).reshape(-1, 2)
    owner = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h[:, 1], h[:, 0]))
    h = h[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]).any(1)])
    group = np.cumsum(new) - 1
    times = np.bincount(group, np.asarray(weight)[owner[order]])
    repeated = np.empty(len(order), bool)
    repeated[order] = times[group] >= 2
    return np.split(repeated, np.cumsum(n)[:-1])


def spec_of(window: int = WINDOW, gram: int = GRAM) -> Windows:
    gram = min(gram, window)
    return Windows(window, gram, text_hashes, lambda h: _grams(h, gram), _seg_keys(window), _payload(window), _find, lambda h: window_hashes(h, window))


def remove_repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_text (kept words joined by one
    space) and kept_sha256.  See the module docstring for defined cases."""
    spans = repeated_spans(df, text_col, spec_of(window), bucket_mb=16, payload_per_char=16 / 6)
    id_type = df.schema[id_col].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            kept, n_words, n_removed = [], [], []
            for text, runs in zip(batch.column("text").to_pylist(), span_runs(batch.column("spans")), strict=True):
                found = words(text)
                gone = covered_by(len(found), runs, window)
                kept.append(b" ".join(w for w, g in zip(found, gone.tolist(), strict=True) if not g) if gone.any() else b" ".join(found))
                n_words.append(len(found))
                n_removed.append(int(gone.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array([k.decode("utf-8", "surrogatepass") for k in kept], pa.string()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
                ["row_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    return (with_spans(df, id_col, text_col, spans)
            .mapInArrow(cut, f"row_id {id_type}, n_words long, n_removed long, kept_text string, kept_sha256 string")
            .withColumnRenamed("row_id", id_col))
