"""Registered queries: job report joins (J01-J04), timeliness (A13),
sample rows (O05)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetrina.operators import quality as Q
from vetrina.operators import reports as RP
from vetrina.operators.rules import issues_long
from vetrina.plans.fixtures import raw_product, raw_product_sql
from vetrina.plans.q_quality import ISSUES_LONG_SQL
from vetrina.plans.q_streaming import ENV_SQL, envelopes
from vetrina.plans.q_validation import validated_products
from vetrina.plans.registry import register, round_doubles
from vetrina.plans.sqlfrag import r6
from vetrina.sources.reference_data import rules_df, seed_rules


def _job_id(client, ingest):
    return F.sha2(F.concat_ws("|", client, ingest), 256)


@register("j01_j04_job_report", f"""{ISSUES_LONG_SQL},
files AS (SELECT client_id, ingest_id, count(*) AS row_count FROM raw_product GROUP BY ALL),
jobs AS (SELECT DISTINCT client_id, ingest_id, sha256(client_id || '|' || ingest_id) AS job_id FROM raw_product),
per AS (SELECT sha256(client_id || '|' || ingest_id) AS job_id, count(*) AS n_issues,
               count(*) FILTER (WHERE severity = 'ERROR') AS n_errors,
               count(*) FILTER (WHERE rule_type = 'required') AS n_required,
               count(*) FILTER (WHERE rule_type = 'format') AS n_format FROM long GROUP BY 1)
SELECT jobs.job_id, jobs.client_id, jobs.ingest_id, per.n_issues, per.n_errors, per.n_required, per.n_format,
       files.row_count
FROM jobs JOIN per ON jobs.job_id = per.job_id
LEFT JOIN files ON files.client_id = jobs.client_id AND files.ingest_id = jobs.ingest_id""")
def q_job_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues joined to their job, rule and file."""
    raw = raw_product(spark, sf_dir)
    files = raw.groupBy("client_id", "ingest_id").agg(F.count("*").alias("row_count"))
    jobs = raw.select("client_id", "ingest_id").distinct().withColumn(
        "job_id", _job_id(F.col("client_id"), F.col("ingest_id")))
    iss = issues_long(validated_products(spark, sf_dir))
    results = iss.select(_job_id(F.col("client_id"), F.col("ingest_id")).alias("job_id"), "rule_id", "severity")
    rep = RP.job_report(results, jobs, rules_df(spark, seed_rules()), files)
    return rep.select("job_id", "client_id", "ingest_id", "n_issues", "n_errors", "n_required", "n_format",
                      "row_count")


@register("a13_timeliness", f"""WITH {ENV_SQL},
t AS (SELECT client_id, ingest_id, min(timestamp) AS started_at, max(timestamp) AS completed_at FROM env2 GROUP BY ALL)
SELECT client_id, ingest_id,
  {r6("CASE WHEN floor(epoch(completed_at)) - floor(epoch(started_at)) <= 300 THEN 1.0 ELSE greatest(0.0, 1.0 - (CAST(floor(epoch(completed_at)) - floor(epoch(started_at)) AS DOUBLE) - 300) / 1200.0) END")} AS timeliness
FROM t""")
def q_timeliness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processing time score per job from its first and last event."""
    e = envelopes(spark, sf_dir)
    t = e.groupBy("client_id", "ingest_id").agg(F.min("timestamp").alias("started_at"),
                                                 F.max("timestamp").alias("completed_at"))
    return round_doubles(t.select("client_id", "ingest_id",
                                  Q.timeliness(F.col("started_at"), F.col("completed_at")).alias("timeliness")))


@register("o05_sample_rows", f"""WITH {raw_product_sql()}
SELECT client_id, ingest_id, row_num, "SKU" FROM (
  SELECT *, row_number() OVER (PARTITION BY client_id, ingest_id ORDER BY row_num) AS rk FROM raw_product)
WHERE rk <= 10""")
def q_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten rows of each file (a preview; the limit is the
    feature)."""
    return RP.sample_rows(raw_product(spark, sf_dir).select("client_id", "ingest_id", "row_num", "SKU"))


REQUEST_SQL = ("CASE WHEN ingest_id = 'ing-0' THEN 'tmpl-catalogue' WHEN client_id = 'c1' THEN 'tmpl-c1' "
               "ELSE 'tmpl-demo' END")


@register("p15_application_check", f"""WITH {raw_product_sql()},
jobs AS (SELECT DISTINCT client_id, ingest_id, sha256(client_id || '|' || ingest_id) AS job_id,
                'created' AS status, {REQUEST_SQL} AS template_id FROM raw_product),
t(template_id, template_client, n_fields, n_features) AS (VALUES
  ('tmpl-demo', 'demo', 4, 3), ('tmpl-catalogue', 'global', 6, 3), ('tmpl-c1', 'c1', 6, 3))
SELECT jobs.job_id, jobs.template_id,
       (t.template_client = jobs.client_id OR t.template_client = 'global') AS allowed,
       CASE WHEN (t.template_client = jobs.client_id OR t.template_client = 'global')
            THEN 'mapped' ELSE 'created' END AS new_status,
       CAST(t.n_fields + t.n_features AS BIGINT) AS mapping_count
FROM jobs JOIN t ON jobs.template_id = t.template_id""")
def q_application(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each import job asks for one template (the file decides
    which); the check joins the request to the template on its id: allowed
    for the same client or a global template, status created -> mapped,
    mapping count = field + feature mappings."""
    from vetrina.operators.mapping import (Template, application_check, catalogue_template, demo_template,
                                           template_tables)
    raw = raw_product(spark, sf_dir)
    jobs = raw.select("client_id", "ingest_id").distinct().select(
        _job_id(F.col("client_id"), F.col("ingest_id")).alias("job_id"), "client_id",
        F.lit("created").alias("status"), F.expr(REQUEST_SQL).alias("template_id"))
    cat = catalogue_template()
    tmpls = [demo_template(), cat, Template(cat.field_mappings, cat.feature_mappings, "tmpl-c1", "c1", "c1 template")]
    parts = [template_tables(spark, t) for t in tmpls]
    t_df, f_df, g_df = (parts[0][i].unionByName(parts[1][i]).unionByName(parts[2][i]) for i in range(3))
    out = application_check(jobs, t_df, f_df, g_df)
    return out.select("job_id", "template_id", "allowed", "new_status", "mapping_count")
