"""Quality scores and the gate.

All scores come from one ``groupBy(client_id, ingest_id)`` over the
validated rows: every row carries its own array of failures, so per-row
counts are summed with partial (map-side) aggregation and no join back to
the issue table is needed.  A hot ingest holding a third of the rows costs
one partial-aggregate row per task, not a skewed shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference.
# ---------------------------------------------------------------------------
QUALITY_THRESHOLD = 0.8
DIMENSION_WEIGHTS = {"completeness": 0.2, "accuracy": 0.25, "consistency": 0.15,
                     "validity": 0.2, "uniqueness": 0.1, "timeliness": 0.05,
                     "conformity": 0.05}
TIMELINESS_TARGET_S = 300
TIMELINESS_DEFAULT = 0.8
API_PENALTY = {"ERROR": 1.0, "WARN": 0.5, "INFO": 0.1}
BANDS = [(0.9, "excellent"), (0.8, "good"), (0.7, "fair"), (0.6, "poor")]

KEYS = ("client_id", "ingest_id")


def _count_issues(pred) -> Column:
    return F.size(F.filter("rule_issues", pred))


def row_dimension_counts(validated: DataFrame) -> DataFrame:
    """Per row: issue counts for each quality dimension (A12 inputs)."""
    lower = lambda i: F.lower(F.coalesce(i["message"], F.lit("")))
    return validated.select(
        *[c for c in ("client_id", "ingest_id", "row_num") if c in validated.columns],
        F.size("rule_issues").alias("n_issues"),
        _count_issues(lambda i: i["severity"] == "ERROR").alias("n_error"),
        _count_issues(lambda i: i["severity"] == "WARN").alias("n_warn"),
        _count_issues(lambda i: i["severity"] == "INFO").alias("n_info"),
        _count_issues(lambda i: (i["rule_type"] == "required") | lower(i).contains("missing"))
        .alias("n_completeness"),
        _count_issues(lambda i: (i["severity"] == "ERROR") & i["rule_type"].isin("format", "range", "domain"))
        .alias("n_accuracy"),
        _count_issues(lambda i: (i["severity"] == "WARN") | lower(i).contains("inconsistent"))
        .alias("n_consistency"),
        _count_issues(lambda i: i["rule_type"].isin("format", "domain", "etim")).alias("n_validity"),
        _count_issues(lambda i: lower(i).contains("duplicate")).alias("n_uniqueness"),
        _count_issues(lambda i: (i["rule_type"] == "etim") | lower(i).contains("standard"))
        .alias("n_conformity"),
    )


def gate(validated: DataFrame, threshold: float = QUALITY_THRESHOLD,
         compat: bool = False, by: tuple[str, ...] = KEYS) -> DataFrame:
    """Gate metrics and PASS / WARN / FAIL per ingest.

    validity = 1 - E/rows, consistency = 1 - W/rows (clamped at 0 unless
    ``compat``), completeness = max(0, 1 - 0.1 E), accuracy = validity,
    overall = their mean.  FAIL when E > 0 and overall < threshold, else
    WARN when W > 0, else PASS.  Zero rows -> all 1 and PASS.
    """
    agg = validated.groupBy(*by).agg(
        F.count("*").alias("total_rows"),
        F.sum("n_error").cast("bigint").alias("error_count"),
        F.sum("n_warn").cast("bigint").alias("warning_count"))
    return gate_from_counts(agg, threshold, compat)


def gate_from_counts(agg: DataFrame, threshold: float = QUALITY_THRESHOLD,
                     compat: bool = False) -> DataFrame:
    rows = F.col("total_rows").cast("double")
    e, w = F.col("error_count"), F.col("warning_count")
    validity = 1.0 - e / rows
    consistency = 1.0 - w / rows
    if not compat:
        validity, consistency = F.greatest(validity, F.lit(0.0)), F.greatest(consistency, F.lit(0.0))
    completeness = F.greatest(F.lit(0.0), 1.0 - e * 0.1)
    accuracy = validity
    overall = (completeness + accuracy + consistency + validity) / 4.0
    empty = F.col("total_rows") == 0
    out = agg.select(
        "*",
        F.when(empty, 1.0).otherwise(completeness).alias("completeness"),
        F.when(empty, 1.0).otherwise(accuracy).alias("accuracy"),
        F.when(empty, 1.0).otherwise(consistency).alias("consistency"),
        F.when(empty, 1.0).otherwise(validity).alias("validity"),
        F.when(empty, 1.0).otherwise(overall).alias("overall_score"))
    return out.withColumn(
        "gate_status",
        F.when((F.col("error_count") > 0) & (F.col("overall_score") < threshold), "FAIL")
         .when(F.col("warning_count") > 0, "WARN").otherwise("PASS"))


def timeliness(started: Column | None, completed: Column | None) -> Column:
    """1 within 300 s, then linear decay to 0 at 1500 s; unknown 0.8."""
    if started is None or completed is None:
        return F.lit(TIMELINESS_DEFAULT)
    t = F.unix_timestamp(completed) - F.unix_timestamp(started)
    score = F.when(t <= TIMELINESS_TARGET_S, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), 1.0 - (t - TIMELINESS_TARGET_S) / float(TIMELINESS_TARGET_S * 4)))
    return F.when(started.isNull() | completed.isNull(), F.lit(TIMELINESS_DEFAULT)).otherwise(score)


def detailed_scores(validated: DataFrame, file_times: DataFrame | None = None,
                    compat: bool = False, by: tuple[str, ...] = KEYS) -> DataFrame:
    """Seven dimensions, weighted overall, rates, coverage.

    ``file_times`` (optional, keyed like ``by``) carries ``started_at`` /
    ``completed_at`` for timeliness.  Affected rows count rows with at least
    one failure; ``compat`` leaves row 0 out as the reference does.
    """
    d = row_dimension_counts(validated)
    affected = (F.col("n_issues") > 0)
    if compat:
        affected = affected & (F.coalesce(F.col("row_num"), F.lit(0)) != 0)
    agg = d.groupBy(*by).agg(
        F.count("*").alias("total_rows"),
        *[F.sum(c).cast("bigint").alias(c) for c in
          ("n_issues", "n_error", "n_warn", "n_info", "n_completeness", "n_accuracy",
           "n_consistency", "n_validity", "n_uniqueness", "n_conformity")],
        F.count_if(affected).alias("affected_rows"))
    if file_times is not None:
        agg = agg.join(file_times.select(*by, "started_at", "completed_at"), list(by), "left")
        tl = timeliness(F.col("started_at"), F.col("completed_at"))
    else:
        tl = timeliness(None, None)
    rows = F.greatest(F.col("total_rows"), F.lit(1)).cast("double")
    dim = lambda n, k=1.0: F.greatest(F.lit(0.0), 1.0 - F.col(n) / rows * k)
    scored = agg.select(
        *by, "total_rows", F.col("n_issues").alias("total_issues"),
        F.col("n_error").alias("error_count"), F.col("n_warn").alias("warning_count"),
        F.col("n_info").alias("info_count"), "affected_rows",
        dim("n_completeness").alias("completeness"),
        dim("n_accuracy").alias("accuracy"),
        dim("n_consistency", 0.5).alias("consistency"),
        dim("n_validity").alias("validity"),
        dim("n_uniqueness").alias("uniqueness"),
        tl.alias("timeliness"),
        dim("n_conformity").alias("conformity"),
        (F.col("n_error") / rows).alias("error_rate"),
        (F.col("n_warn") / rows).alias("warning_rate"),
        (F.col("n_issues") / rows).alias("issue_rate"),
        ((F.col("total_rows") - F.col("affected_rows")) / rows).alias("data_coverage"))
    overall = sum(F.col(k) * w for k, w in DIMENSION_WEIGHTS.items())
    return scored.withColumn("overall_score", overall)


def issues_by(issues: DataFrame, column: str, by: tuple[str, ...] = KEYS) -> DataFrame:
    """Issue counts by rule type or by target column (null -> unknown)."""
    return (issues.groupBy(*by, F.coalesce(F.col(column), F.lit("unknown")).alias(column))
            .agg(F.count("*").alias("issue_count")))


def api_score(issues: DataFrame, by: tuple[str, ...] = KEYS) -> DataFrame:
    """Penalties 1 / 0.5 / 0.1 per ERROR / WARN / INFO;
    score = max(0, 1 - penalty/100); any ERROR -> FAIL, any WARN -> WARN."""
    agg = issues.groupBy(*by).agg(
        F.count_if(F.col("severity") == "ERROR").alias("error_count"),
        F.count_if(F.col("severity") == "WARN").alias("warn_count"),
        F.count_if(F.col("severity") == "INFO").alias("info_count"))
    penalty = (F.col("error_count") * API_PENALTY["ERROR"] + F.col("warn_count") * API_PENALTY["WARN"]
               + F.col("info_count") * API_PENALTY["INFO"])
    return agg.select(
        "*", F.greatest(F.lit(0.0), 1.0 - penalty / 100.0).alias("quality_score"),
        F.when(F.col("error_count") > 0, "FAIL").when(F.col("warn_count") > 0, "WARN")
         .otherwise("PASS").alias("gate_status"))


def api_quality_analysis(issues: DataFrame, by: tuple[str, ...] = KEYS) -> DataFrame:
    """Four dimensions on the share of issues, and their mean."""
    agg = issues.groupBy(*by).agg(
        F.count("*").alias("total_issues"),
        F.count_if(F.col("severity") == "ERROR").alias("error_count"),
        F.count_if(F.col("severity") == "WARN").alias("warn_count"),
        F.count_if(F.col("severity") == "INFO").alias("info_count"),
        F.count_distinct("row_num").alias("affected_rows"))
    n = F.greatest(F.col("total_issues"), F.lit(1)).cast("double")
    e, w = F.col("error_count"), F.col("warn_count")
    dims = {
        "completeness": F.greatest(F.lit(0.0), 1.0 - (e / n) * 0.5),
        "accuracy": F.greatest(F.lit(0.0), 1.0 - e / n),
        "consistency": F.greatest(F.lit(0.0), 1.0 - (w / n) * 0.3),
        "validity": F.greatest(F.lit(0.0), 1.0 - ((e + w) / n) * 0.4),
    }
    out = agg.select("*", *[v.alias(k) for k, v in dims.items()],
                     (e / n).alias("error_rate"), (w / n).alias("warning_rate"))
    return out.withColumn("overall_score", sum(F.col(k) for k in dims) / 4.0)


def recommendations(scores: DataFrame, by: tuple[str, ...] = KEYS) -> DataFrame:
    """Threshold rules -> all recommendations, the score band, and as
    top actions the first three of critical or high priority."""
    rec = lambda cond, cat, prio, title: F.when(cond, F.struct(
        F.lit(cat).alias("category"), F.lit(prio).alias("priority"), F.lit(title).alias("title")))
    arr = F.filter(F.array(
        rec(F.col("completeness") < 0.8, "completeness", "high", "Improve Data Completeness"),
        rec(F.col("accuracy") < 0.7, "accuracy", "high", "Fix Data Accuracy Issues"),
        rec(F.col("error_count") > 0, "errors", "critical", "Resolve Critical Errors"),
        rec(F.col("timeliness") < 0.7, "performance", "low", "Optimize Processing Performance"),
    ), lambda x: x.isNotNull())
    band = F.lit("critical")
    for lo, name in reversed(BANDS):
        band = F.when(F.col("overall_score") >= lo, F.lit(name)).otherwise(band)
    return scores.select(*by, "overall_score", band.alias("band"),
                         F.slice(F.filter(arr, lambda x: x["priority"].isin("critical", "high")), 1, 3).alias("top_actions"),
                         arr.alias("recommendations"), F.size(arr).alias("n_recommendations"))


def historical_comparison(reports: DataFrame, current: DataFrame, as_of,
                          window_days: int = 30) -> DataFrame:
    """Per client, averages over [as_of - 30 d, as_of - 1 d) and the
    trend of the current score against them.  ``as_of`` is a parameter,
    never the wall clock."""
    t = F.col("created_at")
    lo = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {window_days} DAYS")
    hi = F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 1 DAYS")
    hist = (reports.filter((t >= lo) & (t < hi)).groupBy("client_id")
            .agg(F.avg("quality_score").alias("historical_average"),
                 F.count("*").alias("total_historical_files"),
                 F.avg("error_count").alias("avg_historical_errors"),
                 F.avg("warning_count").alias("avg_historical_warnings")))
    j = current.join(hist, "client_id", "left")
    return j.select(
        *current.columns, "historical_average", F.coalesce("total_historical_files", F.lit(0)).alias("total_historical_files"),
        "avg_historical_errors", "avg_historical_warnings",
        (F.col("current_score") - F.col("historical_average")).alias("improvement"),
        F.when(F.col("historical_average").isNull(), "no_history")
         .when(F.col("current_score") > F.col("historical_average"), "improving")
         .otherwise("declining").alias("trend"))
