"""Staging tables (S09, S10): raw and mapped rows as Parquet partitioned
by (client_id, ingest_id).

A read of one ingest is a partition-pruned scan; an update of one ingest
rewrites only that partition (dynamic partition overwrite), so concurrent
ingests never touch each other's files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITIONS = ["client_id", "ingest_id"]


def clustered(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows dealt by ranges of (client, ingest, row number): a small ingest is
    one file, and an ingest with a third of all rows is written by a third of
    the tasks, each a range of its rows.  Without ``partitions`` Spark and AQE
    choose how many."""
    order = [*PARTITIONS, *[c for c in ("row_num",) if c in df.columns]]
    return df.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)


def write_staging(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """S10 (first write): rows clustered by partition keys before writing,
    so each task writes few files per ingest."""
    (clustered(df, partitions).write.mode("overwrite").partitionBy(*PARTITIONS).parquet(path))


def upsert_staging(df: DataFrame, path: str) -> None:
    """Replace only the (client, ingest) partitions present in ``df``."""
    spark = df.sparkSession
    prev = spark.conf.get("spark.sql.sources.partitionOverwriteMode", "static")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        clustered(df).write.mode("overwrite").partitionBy(*PARTITIONS).parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", prev)


def read_staging(spark: SparkSession, path: str, client_id: str, ingest_id: str,
                 ordered: bool = False) -> DataFrame:
    """Rows of one ingest (partition pruning); ``ordered`` sorts by
    row_num only when a consumer needs file order."""
    df = spark.read.parquet(path).filter((F.col("client_id") == client_id) & (F.col("ingest_id") == ingest_id))
    return df.orderBy("row_num") if ordered else df
