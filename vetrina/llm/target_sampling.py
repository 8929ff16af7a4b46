"""Operator 11, target-distribution importance resampling.

Documents are drawn without replacement, with weights that move the draw
towards a target text collection: hashed word 1-grams to 3-grams are counted
in buckets over all documents and over the target, a document's weight is the
sum of its features' log ratios, and the highest of weight plus Gumbel noise
are drawn.

* **Features.** An Arrow batch is split into words with one byte table, its
  distinct words get codes, and pairs and triples of codes give the distinct
  features.  Their bytes are grouped by equal length into two-dimensional
  uint8 arrays; all CRCs of an array advance together, column by column, and
  the buckets are scattered back to the features' places.  Features longer
  than ``ROW`` bytes are cut into rows of ``ROW`` bytes, whose CRCs are joined
  pairwise (a CRC is linear over GF(2)), so a word of any length costs no
  Python loop over its bytes.
* **Two passes.** The first returns one row of counts per bucket and task and
  adds them up; the ``buckets`` gains (a bounded array) go to the second,
  which scores every document where it is read.
* **The draw.** Scores are written, then sorted by range with the places
  inside each range numbered while they are written, and only the number of
  rows per range reaches the driver.  No task holds more than its range, and
  the last tie-breaker is unique, so rows that share a key split too.

Defined cases: a null text counts as empty and has no features, weight 0 and
a score of noise alone; a null id draws noise as the empty string does and
comes last among ties; rows that share an id are rows of their own, ordered
by text hash; with no target text all gains come from the documents alone;
an empty table gives an empty result; other columns are not returned.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetrina.llm.common import by_bytes, materialize, pieces_for, whole_text

BUCKETS, NGRAM, ROW = 10_000, 3, 64
ROWS = 1 << 15  # strings whose CRCs advance together
RESULT = ("n_features", "weight", "score", "rank")
RANGE_ROWS = 500_000  # rows of one range of the draw

# Word bytes and ASCII lower case; the word pattern is [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
# after A-Z became a-z, so every byte from 0x80 on belongs to a word.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True


@functools.cache
def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> 1) ^ (np.uint32(0xEDB88320) * (t & 1))
    return t


def _advance(state: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Registers after the bytes of a matrix whose rows hold the first, second
    ... byte of every string."""
    table = _crc_table()
    for column in matrix:
        state = table[(state ^ column).astype(np.uint8)] ^ (state >> np.uint32(8))
    return state


@functools.cache
def _over_zeros(level: int) -> np.ndarray:
    """Four tables that move a register over ROW * 2**level zero bytes."""
    if level:
        half = _over_zeros(level - 1)
        return np.stack([_shifted(t, half) for t in half])
    units = np.arange(256, dtype=np.uint32)
    zeros = np.zeros((ROW, 256), np.uint8)
    return np.stack([_advance(units << np.uint32(8 * k), zeros) for k in range(4)])


def _shifted(state: np.ndarray, tables: np.ndarray) -> np.ndarray:
    out = tables[0][state & 0xFF]
    for k in (1, 2, 3):
        out = out ^ tables[k][(state >> np.uint32(8 * k)) & 0xFF]
    return out


def _crc_long(data: np.ndarray) -> int:
    """CRC of one long byte row: rows of ROW bytes, joined pair by pair.
    The first row starts from the usual register, all others from 0; zeros
    in front of a register of 0 change nothing, so rows fill up from the
    left and the start value is applied to the first real bytes."""
    first = data[:4] ^ np.uint8(0xFF)  # a register of all ones is the same as inverted first bytes
    rows = 1 << max(math.ceil(len(data) / ROW) - 1, 0).bit_length()
    padded = np.zeros(rows * ROW, np.uint8)
    padded[len(padded) - len(data) :] = data
    padded[len(padded) - len(data) : len(padded) - len(data) + 4] = first
    state, level = _advance(np.zeros(rows, np.uint32), padded.reshape(rows, ROW).T), 0
    while len(state) > 1:
        state, level = _shifted(state[0::2], _over_zeros(level)) ^ state[1::2], level + 1
    return int(state[0]) ^ 0xFFFFFFFF


def crc32_of(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of the given slices of a byte buffer."""
    out = np.zeros(len(begin), np.uint32)
    lengths = end - begin
    order = np.argsort(lengths, kind="stable")
    for which in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        if not len(which):
            continue
        length = int(lengths[which[0]])
        if length > ROW:
            for w in which:
                out[w] = _crc_long(data[begin[w] : end[w]])
            continue
        windows = np.lib.stride_tricks.sliding_window_view(data, length)
        for part in np.array_split(which, len(which) // ROWS + 1):
            matrix = np.ascontiguousarray(windows[begin[part]].T)
            out[part] = _advance(np.full(len(part), 0xFFFFFFFF, np.uint32), matrix) ^ np.uint32(0xFFFFFFFF)
    return out


class Words:
    """The words of an Arrow string column: the text each is in, its code
    among the distinct words, and its place in a buffer where words stand one
    space apart, so that every run of words is one slice."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        data = _LOWER[data]
        inside = _IS_WORD[data]
        starts = inside.copy()  # a word byte after another one, or first in its text
        starts[1:] &= ~inside[:-1]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        starts[edges] = inside[edges]
        gap = ~inside
        gap[1:] &= inside[:-1]
        data[gap] = 32
        kept = inside | gap
        at = np.flatnonzero(starts)
        self.text = np.searchsorted(offsets[1:], at, side="right")
        self.joined = data[kept]
        self.begin = (np.cumsum(kept, dtype=np.int64) - 1)[at]
        bounds = np.append((np.cumsum(inside, dtype=np.int64) - 1)[at], np.count_nonzero(inside))
        self.end = self.begin + np.diff(bounds)
        binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(data[inside])])
        coded = binary.dictionary_encode()
        self.code, self.distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)

    def runs(self, longest: int, buckets: int):
        """For n from 1 on, of each run of n words of one text: the text it is
        in and its bucket."""
        keys, size = self.code, self.distinct
        for n in range(1, longest + 1):
            if n > 1:  # distinct runs of n words: pairs of a run of n - 1 and the word after it
                keys = keys[:-1] * np.int64(self.distinct) + self.code[n - 1 :]
                coded = pa.array(keys).dictionary_encode()
                keys, size = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
            whole = self.text[: len(keys)] == self.text[n - 1 :]
            one = np.full(size, -1, np.int64)  # a place where the run stands whole in a text
            at = np.flatnonzero(whole)
            one[keys[at]] = at
            used = one[one >= 0]
            bucket = np.zeros(size, np.int64)
            bucket[one >= 0] = crc32_of(self.joined, self.begin[used], self.end[used + n - 1]) % np.uint32(buckets)
            yield self.text[at], bucket[keys[at]]
            if not len(at):
                break


def _features(batches, column: str, buckets: int):
    for batch in by_bytes(batches, column, 1 << 20):
        words = Words(batch.column(column))
        runs = list(words.runs(NGRAM, buckets))
        yield batch, words, np.concatenate([r for r, _ in runs]), np.concatenate([b for _, b in runs])


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket; one row per bucket and task is
    shuffled, ``buckets`` rows reach the driver."""
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for _, _, _, places in _features(batches, "text", buckets):
            total += np.bincount(places, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    rows = texts.select(whole_text(text_col).alias("text")).mapInArrow(count, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log ratio of each bucket, one added to every
    count."""
    s, t, m = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((a + 1.0) * (s + m) / ((b + 1.0) * (t + m)))) for a, b in zip(target.tolist(), source.tolist())], np.int64)


def score_documents(df: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """id, n_words, n_features, weight, score and t11_tie (a text hash)."""
    buckets = len(gain)

    def weigh(batches):
        for batch, words, row, places in _features(batches, "text", buckets):
            n = batch.num_rows
            order = np.argsort(row, kind="stable")
            sums = np.concatenate([[0], np.cumsum(gain[places[order]])])
            features = np.bincount(row, minlength=n)
            ends = np.cumsum(features)
            weight = sums[ends] - sums[ends - features]
            arrays = [np.bincount(words.text, minlength=n), features, weight]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("t11_tie"), *(pa.array(a.astype(np.int64)) for a in arrays)],
                                             ["row_id", "t11_tie", "n_words", "n_features", "weight"])

    id_type = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(f"`{id_col}`").alias("row_id"), whole_text(text_col).alias("text")).withColumn("t11_tie", F.xxhash64("text"))
    scored = rows.mapInArrow(weigh, f"row_id {id_type}, t11_tie long, n_words long, n_features long, weight long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("row_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    return scored.withColumn("score", F.col("weight") + noise)


def importance_resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
                        percent: int = 5, min_words: int = 20, buckets: int = BUCKETS, seed: int = 42) -> DataFrame:
    """Every document's id, n_features, weight, score and rank: 1, 2, 3 ...
    for the ``percent`` of 100 documents of at least ``min_words`` words that
    are drawn, null for all others."""
    gain = gains(bucket_counts(df, text_col, buckets), bucket_counts(target, target_col, buckets))
    scored = materialize(score_documents(df, gain, id_col, text_col, seed).withColumn("t11_row", F.monotonically_increasing_id()), "importance-scores")
    able = F.col("n_words") >= min_words
    total, eligible = scored.agg(F.count(F.lit(1)), F.count(F.when(able, 1))).first()
    drawn = percent * eligible // 100

    order = [F.when(able, 0).otherwise(1), F.desc("score"), F.asc_nulls_last("row_id"), F.col("t11_tie"), F.col("t11_row")]
    ranges = scored.repartitionByRange(pieces_for(total, RANGE_ROWS, 8), *order).sortWithinPartitions(*order)
    placed = materialize(ranges.withColumn("t11_at", F.monotonically_increasing_id()), "importance-ranges")
    sizes = sorted(tuple(r) for r in placed.groupBy(F.shiftright("t11_at", 33).alias("part")).count().collect())
    before, at = {}, 0
    for part, n in sizes:
        before[part], at = at, at + n
    starts = df.sparkSession.createDataFrame(pa.table({"t11_part": pa.array(list(before), pa.int64()), "t11_before": pa.array(list(before.values()), pa.int64())}))
    place = F.col("t11_before") + F.col("t11_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return (placed.withColumn("t11_part", F.shiftright("t11_at", 33)).join(starts, "t11_part", "left")
            .select(F.col("row_id").alias(id_col), "n_features", "weight", "score", F.when(place <= drawn, place).alias("rank")))
