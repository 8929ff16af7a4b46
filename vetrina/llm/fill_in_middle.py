"""Operator 12, fill-in-middle transformation.

Each text is cut at two line boundaries drawn from its id and written as
prefix, suffix and middle behind sentinels.  A Fenwick tree over fixed blocks
of the text's UTF-8 bytes holds the lines that end and the code points that
begin in each block.  A binary-lifting descent finds the block in which the
k-th line ends and the code points before it; only that block is then read to
place the cut.  The draw needs no other row, so the job is one pass without a
shuffle.

A line is ``[^\\n]*\\n|[^\\n]+``; with n lines the cuts fall after the smaller
and the larger of two draws from 0 to n.  Forms: ``psm`` (prefix, suffix,
middle), ``spm`` (suffix, prefix, middle), ``plain`` (the text as it stands).

Defined cases: a null text counts as empty; empty texts and texts that hold a
sentinel stay plain; a null id draws as the empty string does; rows that share
an id draw the same numbers; an empty table gives an empty result; of the
input columns, those named like a result column are replaced, all others are
returned, but for the text, which ``output`` holds.  A text is handled whole, whatever its length; one text and its
output are in memory at a time, besides the Arrow batch they came in.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vetrina.llm.common import by_bytes, whole_text

SENTINELS = ("<P>", "<S>", "<M>")  # before prefix, suffix, middle
RESULT = ("n", "form", "prefix_chars", "middle_chars", "output")
BLOCK = 4096  # bytes of text a tree entry stands for


class Cut(NamedTuple):
    at: int  # bytes before the cut
    chars: int  # code points before it


class BlockTree:
    """Lines ended and code points begun, per fixed block, as two Fenwick
    trees of one shape."""

    def __init__(self, data: bytes, block: int = BLOCK):
        self.data, self.block = np.frombuffer(data, np.uint8), block
        begins = np.arange(0, len(data), block)
        self.size = len(begins)
        self.top = 1 << max(self.size.bit_length() - 1, 0)
        if self.size:
            self.ended = self._tree(np.add.reduceat(self.data == 10, begins, dtype=np.int64))
            self.begun = self._tree(np.add.reduceat((self.data & 0xC0) != 0x80, begins, dtype=np.int64))
        self.lines = self._before(self.ended, self.size) + int(data[-1] != 10) if data else 0

    @staticmethod
    def _tree(counts: np.ndarray) -> np.ndarray:
        below = np.concatenate([[0], np.cumsum(counts)])
        i = np.arange(len(below))
        return below - below[i - (i & -i)]  # entry i covers the last (i & -i) blocks

    @staticmethod
    def _before(tree: np.ndarray, blocks: int) -> int:
        total = 0
        while blocks:
            total += int(tree[blocks])
            blocks &= blocks - 1
        return total

    def after(self, lines: int) -> Cut:
        """The cut after so many lines (0 to ``self.lines``)."""
        if lines <= 0 or not self.size:
            return Cut(0, 0)
        blocks, chars, step = 0, 0, self.top
        while step:  # the most blocks in which fewer lines end
            to = blocks + step
            if to <= self.size and self.ended[to] < lines:
                blocks, lines, chars = to, lines - int(self.ended[to]), chars + int(self.begun[to])
            step >>= 1
        begin = blocks * self.block
        if blocks == self.size:  # the last line has no line feed
            return Cut(len(self.data), chars)
        ends = np.flatnonzero(self.data[begin : begin + self.block] == 10)
        at = begin + int(ends[lines - 1]) + 1
        return Cut(at, chars + int(np.count_nonzero((self.data[begin:at] & 0xC0) != 0x80)))


def transform(text: str, draw: str, rate: int, spm_rate: int, sentinels: tuple[str, str, str] = SENTINELS, block: int = BLOCK):
    """(n, form, prefix_chars, middle_chars, output) of one text; ``draw`` is
    what the numbers are drawn from."""
    data = text.encode()
    tree = BlockTree(data, block)
    n = tree.lines
    digest = hashlib.sha256(draw.encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or h3 % 100 >= rate or any(s in text for s in sentinels):
        return n, "plain", None, None, text
    one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = tree.after(one), tree.after(two)
    before, middle, after = data[: a.at].decode(), data[a.at : b.at].decode(), data[b.at :].decode()
    p, s, m = sentinels
    form = "spm" if h4 % 100 < spm_rate else "psm"
    parts = (s, after, p, before) if form == "spm" else (p, before, s, after)
    return n, form, a.chars, b.chars - a.chars, "".join((*parts, m, middle))


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm_rate: int = 50,
                   sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Input rows with n, form, prefix_chars, middle_chars and output.
    ``rate`` of 100 texts are cut, ``spm_rate`` of 100 of those as spm."""
    own = [c for c in df.columns if c not in RESULT and c != text_col]
    kept = [F.col(f"`{c}`").alias(f"f12_{i}") for i, c in enumerate(own)]
    rows = df.select(*kept, whole_text(text_col).alias("f12_text"),
                     F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).alias("f12_draw"))
    held = rows.schema[: len(own)]
    schema = T.StructType([*held, *(T.StructField(c, T.StringType() if c in ("form", "output") else T.LongType()) for c in RESULT)])

    def run(batches):
        for batch in by_bytes(batches, "f12_text"):
            made = [transform(t, d, rate, spm_rate, sentinels) for t, d in zip(batch.column("f12_text").to_pylist(), batch.column("f12_draw").to_pylist())]
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array([m[k] for m in made], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in held), *columns], [*(f.name for f in held), *RESULT])

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"f12_{i}").alias(c) for i, c in enumerate(own)], *RESULT)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text, from the output and its form alone."""
    cut = F.split(output, "|".join(map(re.escape, sentinels)), -1)  # "", part, part, middle
    return (F.when(form == "psm", F.concat(cut[1], cut[3], cut[2]))
            .when(form == "spm", F.concat(cut[2], cut[3], cut[1])).otherwise(output))
