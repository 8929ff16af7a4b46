"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import math

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetrina.session import materialize, scratch_path

__all__ = ["materialize", "scratch_path", "whole_text", "text_key", "chars", "pieces_for", "table", "by_bytes", "each", "small_batches"]

BATCH_ROWS = 1000  # whole texts sent to Python at once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy scan of one driver table through Spark's own reader."""
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def whole_text(col: str):
    """The text as it stands; null counts as empty."""
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(""))


def text_key(col):
    """16 bytes of SHA-256: rows with one key have one text."""
    return F.unhex(F.substring(F.sha2(col, 256), 1, 32))


def chars(df: DataFrame, col: str) -> int:
    """Characters of a text column over all rows (one aggregate)."""
    row = df.agg(F.sum(F.length(F.col(col)).cast("long"))).first()
    return int(row[0] or 0)


def pieces_for(total: float, each: float, least: int = 1) -> int:
    """How many pieces keep every piece at about ``each``."""
    return max(least, math.ceil(total / each))


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let the session send at most ``rows`` rows to Python at once: a batch of
    whole texts is held by the JVM's buffers and by the worker.  A smaller
    setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def each(column):
    """The values of an Arrow column one at a time; ``to_pylist`` holds all of
    them at once."""
    return (value.as_py() for value in column)


def by_bytes(batches, column: str, most: int = 1 << 24):
    """The Arrow batches, cut so that ``column`` holds about ``most`` bytes in
    each (one row more, however long)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(sizes, dtype=np.int64) // most
        ends = [*(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(sizes)]
        begin = 0
        for end in ends:
            if end > begin:
                yield batch.slice(begin, end - begin)
            begin = end
