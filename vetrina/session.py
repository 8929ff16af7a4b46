"""Session helpers: building a session, the shared checkpoint folder, and
written cut points.

Nothing here is specific to one operator.  The rules every module follows:

* the checkpoint folder comes from ``spark.checkpoint.dir`` of the running
  session (a shared folder on a cluster); only when it is unset -- tests,
  local runs -- do we pick a scratch folder ourselves;
* no join strategy is fixed by a row count: Spark's byte thresholds and AQE
  choose between broadcast and shuffle.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Where the local fallback checkpoint folder is remembered (tests only).
SCRATCH_KEY = "vetrina.scratch.dir"


def build_session(master: str | None = None, app: str = "vetrina",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings every job here assumes (UTC, AQE on)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    cores = os.cpu_count() or 8
    b = (b.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true")
          .config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.driver.memory", os.environ.get("VETRINA_DRIVER_MEMORY", "16g")))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, registering it with the context.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and we use it
    as is.  Only when it is unset on a ``local`` master (tests, a laptop) do
    we create a scratch folder; a cluster without the setting is an error,
    since its executors would not see each other's files.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(SCRATCH_KEY, None)
    if not path:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master {master})")
        # spark.checkpoint.dir cannot be changed on a running session, so
        # the local fallback is registered with the context and remembered
        # under a key of our own.
        path = tempfile.mkdtemp(prefix="vetrina-ckpt-")
        spark.conf.set(SCRATCH_KEY, path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    import uuid
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut point: write ``df`` as Parquet into the shared checkpoint folder
    and read it back.

    Used between pipeline stages whose expressions would otherwise be
    fused into one projection (mapping + normalisation + matching), which
    can outgrow the code generator and fall back to interpreted
    execution.  The written table also cuts lineage: a lost executor
    re-reads it instead of recomputing the stages before it."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
