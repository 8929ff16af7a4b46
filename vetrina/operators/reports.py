"""Job / file / result joins behind the quality reports.

Jobs and files are one row per (client, ingest); results are the long issue
table.  Results are pre-aggregated per job before any join, so the joins
see one row per job on each side; the rule dimension is reference data whose
size Spark knows, so its byte threshold decides on a broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetrina.operators.profile import top_k_per_group

GLOBAL_CLIENT = "global"


def tenant_scope(df: DataFrame, client_id: str, column: str = "client_id") -> DataFrame:
    """Rows of one client plus shared (``global``) rows; a plain
    filter, so it reaches the scan (and partition pruning on client_id)."""
    return df.filter(F.col(column).isin(client_id, GLOBAL_CLIENT))


def job_report(results: DataFrame, jobs: DataFrame, rules: DataFrame, files: DataFrame) -> DataFrame:
    """J01 results ⋈ jobs, J02 results ⟕ rules, J03 files ⋈ jobs, J04
    jobs ⟕ files: per job its file facts and issue counts by rule type."""
    r = results.join(rules.select(F.col("rule_id"), F.col("rule_type").alias("rtype")),
                     "rule_id", "left")                                               # J02
    per_job = r.groupBy("job_id").agg(
        F.count("*").alias("n_issues"),
        F.count_if(F.col("severity") == "ERROR").alias("n_errors"),
        F.count_if(F.coalesce(F.col("rtype"), F.lit("unknown")) == "required").alias("n_required"),
        F.count_if(F.coalesce(F.col("rtype"), F.lit("unknown")) == "format").alias("n_format"))
    j = jobs.join(per_job, "job_id", "inner")                                         # J01
    return j.join(files, ["client_id", "ingest_id"], "left")                          # J03 / J04


def sample_rows(df: DataFrame, k: int = 10, by: tuple[str, ...] = ("client_id", "ingest_id")) -> DataFrame:
    """The first ``k`` rows of each file by row number (exact top-k
    per file without ranking a whole file in one task)."""
    return top_k_per_group(df, list(by), [F.col("row_num")], k, bucket_key="row_num").drop("rk")
