"""Registered queries: quality reports (A12-A19, A26), job lists (P18, O02,
O03, A24)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vetrina.operators import quality as Q
from vetrina.operators.rules import SEVERITY_RANK, issues_long
from vetrina.plans.q_validation import MAPPED_SQL, validated_products
from vetrina.plans.registry import register, round_doubles
from vetrina.plans.sqlfrag import r6
from vetrina.sources.tables import table

AS_OF = "2024-01-31 00:00:00"

ROW_FLAGS = f"""WITH {MAPPED_SQL},
rows AS (SELECT client_id, ingest_id, row_num,
  f_sku + f_gtin + f_len + f_mat AS n_issues, f_sku + f_gtin + f_len AS n_error, f_mat AS n_warn,
  f_sku AS n_completeness, f_gtin + f_len AS n_accuracy, f_mat AS n_consistency,
  f_gtin + f_mat AS n_validity FROM checked),
agg AS (SELECT client_id, ingest_id, count(*) AS total_rows, CAST(sum(n_issues) AS BIGINT) AS total_issues,
  CAST(sum(n_error) AS BIGINT) AS error_count, CAST(sum(n_warn) AS BIGINT) AS warning_count,
  CAST(0 AS BIGINT) AS info_count, count(*) FILTER (WHERE n_issues > 0) AS affected_rows,
  sum(n_completeness) AS nc, sum(n_accuracy) AS na, sum(n_consistency) AS ns, sum(n_validity) AS nv
  FROM rows GROUP BY client_id, ingest_id),
sc AS (SELECT *, greatest(0.0, 1.0 - nc / CAST(total_rows AS DOUBLE)) AS completeness,
  greatest(0.0, 1.0 - na / CAST(total_rows AS DOUBLE)) AS accuracy,
  greatest(0.0, 1.0 - ns / CAST(total_rows AS DOUBLE) * 0.5) AS consistency,
  greatest(0.0, 1.0 - nv / CAST(total_rows AS DOUBLE)) AS validity,
  1.0 AS uniqueness, 0.8 AS timeliness, 1.0 AS conformity FROM agg),
sc2 AS (SELECT *, completeness * 0.2 + accuracy * 0.25 + consistency * 0.15 + validity * 0.2
  + uniqueness * 0.1 + timeliness * 0.05 + conformity * 0.05 AS overall_score FROM sc)"""


def _scores(spark, sf_dir):
    return Q.detailed_scores(validated_products(spark, sf_dir))


@register("a12_quality_dimensions", f"""{ROW_FLAGS}
SELECT client_id, ingest_id, total_rows, total_issues, error_count, warning_count, info_count, affected_rows,
  {r6('completeness')} AS completeness, {r6('accuracy')} AS accuracy, {r6('consistency')} AS consistency,
  {r6('validity')} AS validity, {r6('uniqueness')} AS uniqueness, {r6('timeliness')} AS timeliness,
  {r6('conformity')} AS conformity,
  {r6('error_count / CAST(total_rows AS DOUBLE)')} AS error_rate,
  {r6('warning_count / CAST(total_rows AS DOUBLE)')} AS warning_rate,
  {r6('total_issues / CAST(total_rows AS DOUBLE)')} AS issue_rate,
  {r6('(total_rows - affected_rows) / CAST(total_rows AS DOUBLE)')} AS data_coverage,
  {r6('overall_score')} AS overall_score
FROM sc2""")
def q_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven weighted dimensions, rates, affected rows."""
    return round_doubles(_scores(spark, sf_dir))


ISSUES_LONG_SQL = f"""WITH {MAPPED_SQL},
long AS (
  SELECT client_id, ingest_id, row_num, 'required' AS rule_type, 'ERROR' AS severity, 'sku' AS target_name
  FROM checked WHERE f_sku = 1
  UNION ALL SELECT client_id, ingest_id, row_num, 'format', 'ERROR', 'gtin' FROM checked WHERE f_gtin = 1
  UNION ALL SELECT client_id, ingest_id, row_num, 'range', 'ERROR', 'EF001001' FROM checked WHERE f_len = 1
  UNION ALL SELECT client_id, ingest_id, row_num, 'domain', 'WARN', 'EF001003' FROM checked WHERE f_mat = 1)"""


@register("a15_issues_by_rule_type", f"""{ISSUES_LONG_SQL}
SELECT client_id, ingest_id, rule_type, count(*) AS issue_count FROM long GROUP BY ALL""")
def q_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue counts by rule type (by column works the same way)."""
    return Q.issues_by(issues_long(validated_products(spark, sf_dir)), "rule_type")


@register("a16_api_score", f"""{ISSUES_LONG_SQL},
c AS (SELECT client_id, ingest_id, count(*) FILTER (WHERE severity = 'ERROR') AS error_count,
       count(*) FILTER (WHERE severity = 'WARN') AS warn_count,
       count(*) FILTER (WHERE severity = 'INFO') AS info_count FROM long GROUP BY ALL)
SELECT *, {r6('greatest(0.0, 1.0 - (error_count * 1.0 + warn_count * 0.5 + info_count * 0.1) / 100.0)')} AS quality_score,
  CASE WHEN error_count > 0 THEN 'FAIL' WHEN warn_count > 0 THEN 'WARN' ELSE 'PASS' END AS gate_status
FROM c""")
def q_api_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Penalty score and gate of the validation API."""
    return round_doubles(Q.api_score(issues_long(validated_products(spark, sf_dir))))


@register("a17_api_quality_analysis", f"""{ISSUES_LONG_SQL},
c AS (SELECT client_id, ingest_id, count(*) AS total_issues,
       count(*) FILTER (WHERE severity = 'ERROR') AS error_count,
       count(*) FILTER (WHERE severity = 'WARN') AS warn_count,
       count(*) FILTER (WHERE severity = 'INFO') AS info_count,
       count(DISTINCT row_num) AS affected_rows FROM long GROUP BY ALL),
d AS (SELECT *, greatest(0.0, 1.0 - (error_count / CAST(total_issues AS DOUBLE)) * 0.5) AS completeness,
       greatest(0.0, 1.0 - error_count / CAST(total_issues AS DOUBLE)) AS accuracy,
       greatest(0.0, 1.0 - (warn_count / CAST(total_issues AS DOUBLE)) * 0.3) AS consistency,
       greatest(0.0, 1.0 - ((error_count + warn_count) / CAST(total_issues AS DOUBLE)) * 0.4) AS validity
      FROM c)
SELECT client_id, ingest_id, total_issues, error_count, warn_count, info_count, affected_rows,
  {r6('completeness')} AS completeness, {r6('accuracy')} AS accuracy, {r6('consistency')} AS consistency,
  {r6('validity')} AS validity, {r6('error_count / CAST(total_issues AS DOUBLE)')} AS error_rate,
  {r6('warn_count / CAST(total_issues AS DOUBLE)')} AS warning_rate,
  {r6('(completeness + accuracy + consistency + validity) / 4.0')} AS overall_score
FROM d""")
def q_api_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions on the share of issues (exact distinct rows)."""
    return round_doubles(Q.api_quality_analysis(issues_long(validated_products(spark, sf_dir))))


@register("a18_recommendations", f"""{ROW_FLAGS}
SELECT client_id, ingest_id, {r6('overall_score')} AS overall_score,
  CASE WHEN overall_score >= 0.9 THEN 'excellent' WHEN overall_score >= 0.8 THEN 'good'
       WHEN overall_score >= 0.7 THEN 'fair' WHEN overall_score >= 0.6 THEN 'poor' ELSE 'critical' END AS band,
  CAST((CASE WHEN completeness < 0.8 THEN 1 ELSE 0 END) + (CASE WHEN accuracy < 0.7 THEN 1 ELSE 0 END)
     + (CASE WHEN error_count > 0 THEN 1 ELSE 0 END) + (CASE WHEN timeliness < 0.7 THEN 1 ELSE 0 END) AS INTEGER)
     AS n_recommendations,
  nullif(concat_ws(',', CASE WHEN completeness < 0.8 THEN 'completeness' END,
     CASE WHEN accuracy < 0.7 THEN 'accuracy' END, CASE WHEN error_count > 0 THEN 'errors' END), '') AS top_actions
FROM sc2""")
def q_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendation list and executive band."""
    r = Q.recommendations(_scores(spark, sf_dir))
    return round_doubles(r.select("client_id", "ingest_id", "overall_score", "band", "n_recommendations",
                                  F.when(F.size("top_actions") > 0,
                                         F.array_join(F.transform("top_actions", lambda x: x["category"]), ","))
                                  .alias("top_actions")))


# --------------------------------------------------------------------------
# Report history derived from events: one report per event, the user is
# the client, value/100 the score, errors and views the issue counts.
# --------------------------------------------------------------------------
def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("client_id"), F.col("ts").cast("timestamp").alias("created_at"),
                    F.least(F.lit(1.0), F.col("value") / 100.0).alias("quality_score"),
                    (F.col("event_type") == "error").cast("int").alias("error_count"),
                    (F.col("event_type") == "view").cast("int").alias("warning_count"))


REPORTS_SQL = """reports AS (SELECT user_id AS client_id, ts AS created_at, least(1.0, value / 100.0) AS quality_score,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS error_count,
  CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS warning_count FROM events)"""


@register("a19_historical_comparison", f"""WITH {REPORTS_SQL},
cur AS (SELECT client_id, arg_max(quality_score, (created_at, quality_score)) AS current_score
        FROM reports WHERE created_at < TIMESTAMP '{AS_OF}' GROUP BY client_id),
hist AS (SELECT client_id, avg(quality_score) AS historical_average, count(*) AS total_historical_files,
                avg(error_count) AS avg_historical_errors, avg(warning_count) AS avg_historical_warnings
         FROM reports WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY
                        AND created_at < TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY GROUP BY client_id)
SELECT cur.client_id, {r6('current_score')} AS current_score, {r6('historical_average')} AS historical_average,
  coalesce(total_historical_files, 0) AS total_historical_files, {r6('avg_historical_errors')} AS avg_historical_errors,
  {r6('avg_historical_warnings')} AS avg_historical_warnings,
  {r6('current_score - historical_average')} AS improvement,
  CASE WHEN historical_average IS NULL THEN 'no_history' WHEN current_score > historical_average
       THEN 'improving' ELSE 'declining' END AS trend
FROM cur LEFT JOIN hist ON cur.client_id = hist.client_id""")
def q_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current score vs the last 30 days (fixed ``as_of``)."""
    r = reports(spark, sf_dir)
    cur = (r.filter(F.col("created_at") < F.lit(AS_OF).cast("timestamp")).groupBy("client_id")
           .agg(F.max_by("quality_score", F.struct("created_at", "quality_score")).alias("current_score")))
    return round_doubles(Q.historical_comparison(r, cur, AS_OF))


@register("a26_weekly_trend", f"""WITH {REPORTS_SQL},
w AS (SELECT client_id, time_bucket(INTERVAL 7 DAY, created_at, TIMESTAMP '1970-01-01') AS week_start,
             avg(quality_score) AS avg_score, count(*) AS n_reports
      FROM reports GROUP BY ALL)
SELECT client_id, week_start, {r6('avg_score')} AS avg_score, n_reports,
  {r6('avg_score - lag(avg_score) OVER (PARTITION BY client_id ORDER BY week_start)')} AS change
FROM w""")
def q_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly average score per client and its change (lag).

    The lag window is partitioned by client over weekly aggregates: a
    client contributes one row per week, so partitions stay small."""
    r = reports(spark, sf_dir)
    w = (r.groupBy("client_id", F.window("created_at", "7 days").alias("win"))
         .agg(F.avg("quality_score").alias("avg_score"), F.count("*").alias("n_reports"))
         .select("client_id", F.col("win.start").alias("week_start"), "avg_score", "n_reports"))
    lag = F.lag("avg_score").over(Window.partitionBy("client_id").orderBy("week_start"))
    return round_doubles(w.withColumn("change", F.col("avg_score") - lag)
                         .withColumn("week_start", F.col("week_start").cast("timestamp_ntz")))


# --------------------------------------------------------------------------
# Jobs: an order stands for an import job of its customer.
# --------------------------------------------------------------------------
def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = (F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "processing")
               .otherwise("failed"))
    return o.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("client_id"),
                    status.alias("status"), F.col("o_orderdate").alias("created_at"))


JOBS_SQL = """jobs AS (SELECT o_orderkey AS job_id, o_custkey AS client_id,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'failed' END AS status,
  o_orderdate AS created_at FROM orders)"""


@register("o02_job_page", f"""WITH {JOBS_SQL}
SELECT job_id, client_id, status, created_at FROM jobs WHERE status = 'processing'
ORDER BY created_at DESC, job_id DESC LIMIT 50 OFFSET 100""")
def q_job_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P18 + O02: filtered job list, one page (limit/offset is the feature)."""
    j = jobs(spark, sf_dir).filter(F.col("status") == "processing")
    return j.orderBy(F.col("created_at").desc(), F.col("job_id").desc()).offset(100).limit(50)


@register("a24_job_counts", f"""WITH {JOBS_SQL}
SELECT status, count(*) AS total FROM jobs GROUP BY status""")
def q_job_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals behind paging, per status filter."""
    return jobs(spark, sf_dir).groupBy("status").agg(F.count("*").alias("total"))


@register("o03_top_issues", f"""{ISSUES_LONG_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY client_id, ingest_id
    ORDER BY CASE severity WHEN 'ERROR' THEN 3 WHEN 'WARN' THEN 2 ELSE 1 END DESC, row_num, rule_type) AS rk
  FROM long)
SELECT client_id, ingest_id, row_num, rule_type, severity, CAST(rk AS INTEGER) AS rk FROM ranked WHERE rk <= 100""")
def q_top_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 100 issues per ingest by severity rank, then row.

    Top-k per ingest uses the exact two-stage top-k, so an ingest holding
    most of the issues is still ranked in parallel."""
    from vetrina.operators.profile import top_k_per_group
    iss = issues_long(validated_products(spark, sf_dir))
    rank = F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv])
    iss = iss.withColumn("sev_rank", F.element_at(rank, F.col("severity")))
    top = top_k_per_group(iss, ["client_id", "ingest_id"],
                          [F.col("sev_rank").desc(), F.col("row_num"), F.col("rule_type")], 100,
                          bucket_key="row_num")
    return top.select("client_id", "ingest_id", "row_num", "rule_type", "severity",
                      F.col("rk").cast("int").alias("rk"))
