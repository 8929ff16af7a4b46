"""Keyset paging (O02): a page begins after the last row of the one before.

An offset makes Spark sort and drop everything before the page, and shifts
when rows are inserted.  A continuation token, the sort key of the last row,
becomes a filter that reaches the scan, and a page costs one distributed
top-k whatever its number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def after(token: tuple, keys: list[str]) -> Column:
    """Rows that come after ``token`` in descending order of ``keys``, nulls
    last: first key less, or equal and the next one less, and so on."""
    out, same = F.lit(False), F.lit(True)
    for value, key in zip(token, keys, strict=True):
        c = F.col(key)
        if value is None:
            same = same & c.isNull()
        else:
            out = out | (same & ((c < F.lit(value)) | c.isNull()))
            same = same & (c == F.lit(value))
    return out


def page(df: DataFrame, keys: list[str], size: int, token: tuple | None = None) -> DataFrame:
    """The next ``size`` rows by ``keys``, descending with nulls last; the keys
    together must be unique.  The limit is the feature."""
    rows = df if token is None else df.where(after(token, keys))
    return rows.orderBy(*[F.col(k).desc_nulls_last() for k in keys]).limit(size)


def token_of(rows: DataFrame, keys: list[str], size: int) -> tuple | None:
    """The token after a full page, None after the last one (at most ``size``
    rows reach the driver)."""
    got = rows.select(*keys).collect()
    return tuple(got[-1]) if len(got) == size else None
