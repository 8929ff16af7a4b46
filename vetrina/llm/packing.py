"""Operator 5, packing of tokenised documents into sequences.

The histogram of piece lengths (at most ``capacity`` rows, whatever the
input) defines a configuration linear program: choose how often each
multiset of lengths that fits a sequence is used, so that all pieces are
covered with the fewest sequences.  Multiplicative weights solve it: a
length's weight is its share of a sequence, more for long ones, times a
factor that grows as its coverage lags behind the whole; a knapsack dynamic
program prices the best configuration of each step, out of lengths not yet
covered.  A step covers at most a quarter of a length and is rounded down to
whole sequences (one at least), so what comes out is integral and holds each
piece once.  Each piece then finds its place by its rank among the pieces of
its length; the pieces never pass through the driver.

A document is its ids and one end id.  Only documents longer than
``capacity`` are cut, into full pieces with a first piece that may be
shorter.

Defined cases: null counts as empty, which is the end id alone; rows that
share an id are packed as rows of their own; an empty table gives an empty
result; other columns are neither read nor returned.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vetrina.llm.common import materialize, pieces_for, whole_text

CAPACITY, END_ID, SALT_ROWS = 1024, 2, 200_000
#: Steps in which a length is covered at least (if it has so many pieces), how
#: fast a lagging length gains weight, and how much more a long one weighs; the
#: program is solved once for each of the last, until one solution is best.
STEPS, RATE, PULLS = 4, 0.05, (0.1, 0.3)


# -- tokens -------------------------------------------------------------

@functools.lru_cache(maxsize=2)
def _byte_encoder(path: str, pattern: str):
    """ids of a byte-level BPE vocabulary file.  The rank encoder gives the
    same ids as the file's own library, several times faster; that library
    takes the texts that the rank encoder's pattern engine gives up on."""
    import tiktoken
    from tokenizers import Tokenizer
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # the usual printable stand-ins of bytes in such files
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    stand_in = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(stand_in[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    exact = Tokenizer.from_file(path)
    exact.no_truncation()
    exact.no_padding()

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all").astype(np.uint32)
        except BaseException as e:  # the pattern engine's panic is no Exception
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def token_pieces(df: DataFrame, id_col: str, text_col: str, path: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """(row_id, piece, start, length, ids_crc32[, ids]) of every document."""
    id_type = df.schema[id_col].dataType.simpleString()
    names = ["row_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]

    def cut(batches):
        encode = _byte_encoder(path, pattern)
        for batch in batches:
            of, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                whole = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                first = len(whole) % capacity or capacity
                edges = [0, *range(first, len(whole) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    of.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(whole[a:b].tobytes()))
                    if keep_ids:
                        ids.append(whole[a:b].astype(np.int32))
            columns = [batch.column("row_id").take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.list_(pa.int32()))] if keep_ids else []), names)

    rows = df.select(F.col(f"`{id_col}`").alias("row_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(cut, f"row_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


# -- the linear program -------------------------------------------------

def best_configuration(sizes: np.ndarray, price: np.ndarray, capacity: int) -> dict[int, int]:
    """Unbounded knapsack by dynamic programming: the configuration of
    greatest total price, as {position in sizes: times}."""
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")  # sizes ascend
    for c in range(int(sizes[0]), capacity + 1):
        gain = value[c - sizes[: fits[c]]] + price[: fits[c]]
        k = int(gain.argmax())
        if gain[k] > value[c - 1]:
            value[c], choice[c] = gain[k], k
        else:
            value[c] = value[c - 1]
    out: dict[int, int] = defaultdict(int)
    c = capacity
    while c > 0:
        k = int(choice[c])
        if k < 0:
            c -= 1
        else:
            out[k] += 1
            c -= int(sizes[k])
    return dict(out)


def priced_configuration(sizes: np.ndarray, price: np.ndarray, left: np.ndarray, capacity: int) -> dict[int, int]:
    """A configuration of pieces that are left, to which none that is left
    could be added: the best one, and where that asks for more pieces of a
    length than there are, the best one again for the room that remains."""
    use: dict[int, int] = defaultdict(int)
    have, room = left.copy(), capacity
    while len(k := np.flatnonzero((have > 0) & (sizes <= room))):
        for i, times in best_configuration(sizes[k], price[k], room).items():
            times = min(times, int(have[k[i]]))
            use[int(k[i])] += times
            have[k[i]] -= times
            room -= times * int(sizes[k[i]])
    return dict(use)


def covering(sizes: np.ndarray, count: np.ndarray, capacity: int, steps: int, pull: float) -> dict[tuple, int]:
    """Multiplicative weights for: fewest configurations that cover count, in
    whole sequences.  {((position in sizes, times), ...): sequences}"""
    plan: dict[tuple, int] = defaultdict(int)
    left, total = count.copy(), int(sizes @ count)
    base = sizes / capacity * (1 + pull * sizes / capacity)
    while left.any():
        lag = left / count - (sizes @ left) / total  # behind the whole's coverage
        use = priced_configuration(sizes, base * np.exp(RATE * lag), left, capacity)
        k, times = np.array(list(use)), np.array(list(use.values()))
        n = max(1, min(int((count[k] / (steps * times)).min()), int((left[k] // times).min())))
        left[k] -= n * times
        plan[tuple(sorted(use.items()))] += n
    return plan


def configurations(histogram: dict[int, int], capacity: int, steps: int = STEPS) -> list[tuple[tuple, int]]:
    """[(((length, times), ...), sequences)] that hold every piece exactly."""
    whole = [(((capacity, 1),), histogram[capacity])] if histogram.get(capacity) else []
    rest = {size: n for size, n in histogram.items() if n and size < capacity}
    if not rest:
        return whole
    sizes = np.array(sorted(rest))
    count = np.array([rest[s] for s in sizes.tolist()])
    best: dict[tuple, int] = {}
    for pull in PULLS:
        plan = covering(sizes, count, capacity, steps, pull)
        if not best or sum(plan.values()) < sum(best.values()):
            best = plan
        if sum(best.values()) == -(-int(sizes @ count) // capacity):
            break  # no packing has fewer
    return whole + [(tuple((int(sizes[k]), t) for k, t in reversed(p)), n) for p, n in best.items()]


def places(plan: list[tuple[tuple, int]]) -> dict[int, np.ndarray]:
    """Per length the rows (first rank, times, first sequence, offset) that
    turn a rank among the pieces of a length into a place."""
    rows: dict[int, list] = defaultdict(list)
    rank: dict[int, int] = defaultdict(int)
    sequence = 0
    for uses, n in plan:
        offset = 0
        for size, times in uses:
            rows[size].append((rank[size], times, sequence, offset))
            rank[size] += times * n
            offset += size * times
        sequence += n
    return {size: np.array(r, np.int64) for size, r in rows.items()}


# -- on Spark -----------------------------------------------------------

def pack_documents(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                   end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset
    and, if ``keep_ids``, its token ids."""
    pieces = materialize(token_pieces(df, id_col, text_col, path, pattern, capacity, end_id, keep_ids), "token-pieces")
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    table = places(configurations(histogram, capacity))

    # rank among the pieces of a length, in salted shares so that no length
    # meets in one task
    salts = pieces_for(sum(histogram.values()), SALT_ROWS, 8)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("row_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("length", "salt", F.coalesce(F.sum("n").over(
        Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("row_id", "piece", "start", "ids_crc32")
    ranked = (salted.withColumn("n", F.row_number().over(order) - 1).join(before, ["length", "salt"])
              .withColumn("rank", F.col("before") + F.col("n")).drop("salt", "n", "before"))
    names = [c for c in pieces.columns]

    def place(batches):
        for batch in batches:
            size, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size).tolist():
                own = np.flatnonzero(size == s)
                rows = table[s]
                row = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
                since = rank[own] - row[:, 0]
                sequence[own] = row[:, 2] + since // row[:, 1]
                offset[own] = row[:, 3] + since % row[:, 1] * s
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    placed = ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")
    return placed.select(F.col("row_id").alias(id_col), *names[1:5], "sequence_id", "offset", *names[5:])
