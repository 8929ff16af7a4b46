"""Upserts against stored tables and what they changed.

A table on plain files has no in-place MERGE, so an upsert builds the next
snapshot.  ``upsert`` does it in one pass: a single full outer join of the
stored and the incoming rows on the key decides per key whether the row is
inserted, replaced, the same or kept, sets ``created_at`` and ``updated_at``
and writes out every row once.  Both sides are shuffled once, on the key; a
key occurs at most once a side, so no key can be hot.

A row's values are compared by ``row_hash``, which the snapshot stores: an
incoming row that changes nothing leaves ``updated_at`` as it was, so an
export of everything updated since an import gives exactly what changed.

Counts come from ``write_counted``: the metrics are observed while the
snapshot is written, in the last stage of the job, without another scan.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from vetrina.session import scratch_path

CHANGES = ("insert", "replace", "same", "keep")
STAMPS = ("created_at", "updated_at", "row_hash")


def row_hash(values: Iterable[tuple[str, Column]]) -> Column:
    """256 bits over named values; null and empty differ (a null field is
    absent from the JSON text)."""
    return F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in values])), 256)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last by ``order``: a partial aggregate, so a key
    with a third of all rows is folded before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    return (rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("__last"))
            .select(*keys, *[F.col(f"__last.`{c}`").alias(c) for c in others]))


def upsert(base: DataFrame | None, rows: DataFrame, keys: list[str], values: list[str], at: Column | None = None,
           how: str = "replace", fixed: Iterable[str] = (), untracked: Iterable[str] = ()) -> DataFrame:
    """The next snapshot: keys, ``fixed``, ``values`` and ``untracked``
    columns, created_at, updated_at, row_hash, and ``change`` (insert,
    replace, same or keep).

    ``rows`` holds a key at most once (see ``latest``).  ``how`` says what
    happens to a stored key: ``replace`` its values, ``fill`` (new values
    where they are not null), or ``nothing`` (ON CONFLICT DO NOTHING).
    ``fixed`` columns keep their stored value, if not null; ``untracked``
    ones are stored like values, but do not make a row changed (where a row
    came from, for instance).  Null keys are
    equal to each other, so applying a set twice is applying it once.  A base
    without the three stamp columns starts with null stamps."""
    at = F.lit(None).cast("timestamp") if at is None else at.cast("timestamp")
    fixed = list(fixed)
    own = [*keys, *fixed, *values, *untracked]
    n = rows.select(*[F.col(f"`{c}`").alias(f"n_{i}") for i, c in enumerate(own)], F.lit(True).alias("n_in"))
    if base is None:
        base = rows.where(F.lit(False))
    stored = set(base.columns)
    o = base.select(*[F.col(f"`{c}`").alias(f"o_{i}") for i, c in enumerate(own)], F.lit(True).alias("o_in"),
                    *[(F.col(c) if c in stored else F.lit(None)).cast("string" if c == "row_hash" else "timestamp").alias(f"o_{c}") for c in STAMPS])
    same_key = reduce(lambda a, b: a & b, [F.col(f"n_{i}").eqNullSafe(F.col(f"o_{i}")) for i in range(len(keys))])
    j = n.join(o, same_key, "full")
    new, old = F.col("n_in").isNotNull(), F.col("o_in").isNotNull()

    def merged(i: int) -> Column:
        mine, theirs = F.col(f"n_{i}"), F.col(f"o_{i}")
        if how == "nothing" or i < len(keys):
            return F.when(old, theirs).otherwise(mine)
        if i < len(keys) + len(fixed):
            return F.coalesce(theirs, mine)
        return F.coalesce(mine, theirs) if how == "fill" else F.when(new, mine).otherwise(theirs)

    j = j.select("*", *[merged(i).alias(f"m_{i}") for i in range(len(own))])
    first = len(keys) + len(fixed)
    now = row_hash((c, F.col(f"m_{first + k}")) for k, c in enumerate(values))
    before = F.coalesce("o_row_hash", row_hash((c, F.col(f"o_{first + k}")) for k, c in enumerate(values)))
    j = j.withColumn("m_hash", now).withColumn("m_before", before)
    change = (F.when(~old, "insert").when(~new | F.lit(how == "nothing"), "keep")
               .when(F.col("m_hash") == F.col("m_before"), "same").otherwise("replace"))
    j = j.withColumn("change", change)
    touched = F.col("change").isin("insert", "replace")
    return j.select(*[F.col(f"m_{i}").alias(c) for i, c in enumerate(own)],
                    F.when(F.col("change") == "insert", at).otherwise(F.col("o_created_at")).alias("created_at"),
                    F.when(touched, at).otherwise(F.col("o_updated_at")).alias("updated_at"),
                    F.col("m_hash").alias("row_hash"), "change")


def write_counted(df: DataFrame, name: str, counts: dict[str, Column]) -> tuple[DataFrame, dict[str, int]]:
    """Write a cut point and count conditions on its rows while writing."""
    seen = Observation(f"{name}-counts")
    path = scratch_path(df.sparkSession, name)
    df.observe(seen, *[F.count_if(c).alias(k) for k, c in counts.items()]).write.parquet(path)
    return df.sparkSession.read.parquet(path), {k: int(v) for k, v in seen.get.items()}


def change_counts(prefix: str) -> dict[str, Column]:
    return {f"{prefix}_{c}": F.col("change") == c for c in CHANGES}
