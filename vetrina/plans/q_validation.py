"""Registered queries: mapping, validation and the quality gate over
``raw_product`` (the supplier-file view of ``part``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetrina.operators import quality
from vetrina.operators.mapping import apply_template, catalogue_template
from vetrina.operators.rules import issues_long, severity_summary, validate
from vetrina.plans.fixtures import raw_product, raw_product_sql
from vetrina.plans.registry import register, round_doubles
from vetrina.plans.sqlfrag import blank, missing, pyfloat, r6, strip
from vetrina.sources.reference_data import (ANCHORED_GTIN_PATTERN, MATERIAL_DOMAIN,
                                            etim_class_feature_df, seed_rules, uom_df)

KEYS = ["client_id", "ingest_id", "row_num"]


def mapped_products(spark: SparkSession, sf_dir: str, template=None) -> DataFrame:
    raw = raw_product(spark, sf_dir)
    return apply_template(raw, template or catalogue_template(), uom=uom_df(spark))


def validated_products(spark: SparkSession, sf_dir: str, compat: bool = False,
                       template=None) -> DataFrame:
    return validate(mapped_products(spark, sf_dir, template), seed_rules(compat), compat=compat,
                    class_features=etim_class_feature_df(spark))


# ---------------------------------------------------------------------------
# SQL restatement of the demo-template mapping and the four seeded rules.
# ---------------------------------------------------------------------------
_DOMAIN = ", ".join(f"'{v}'" for v in MATERIAL_DOMAIN)
_GTIN = ANCHORED_GTIN_PATTERN

MAPPED_SQL = f"""{raw_product_sql()},
mapped AS (
  SELECT client_id, ingest_id, row_num,
    CASE WHEN {missing('"SKU"')} THEN NULL ELSE {strip('"SKU"')} END AS sku,
    CASE WHEN {missing('"Name"')} THEN NULL ELSE {strip('"Name"')} END AS product_name,
    CASE WHEN {missing('"Brand"')} THEN NULL ELSE {strip('"Brand"')} END AS brand,
    CASE WHEN {missing('"GTIN"')} THEN NULL ELSE {strip('"GTIN"')} END AS gtin,
    CASE WHEN {missing('"Price"')} THEN NULL ELSE {strip('"Price"')} END AS price,
    CASE WHEN {missing('"Currency"')} THEN NULL ELSE {strip('"Currency"')} END AS currency,
    CASE WHEN {missing('"Length"')} THEN NULL
         WHEN {strip('"Length"')} = '' THEN "Length" ELSE {strip('"Length"')} END AS len_v,
    CASE WHEN {missing('"Length"')} THEN NULL ELSE "Length_Unit" END AS len_unit,
    CASE WHEN {missing('"Material"')} THEN NULL
         WHEN {strip('"Material"')} = '' THEN "Material" ELSE {strip('"Material"')} END AS mat_v,
    (CASE WHEN {missing('"SKU"')} THEN 1 ELSE 0 END) AS n_map_issues
  FROM raw_product),
checked AS (
  SELECT *,
    CASE WHEN {blank('sku')} THEN 1 ELSE 0 END AS f_sku,
    CASE WHEN NOT {missing('gtin')} AND NOT regexp_full_match(gtin, '{_GTIN[1:-1]}') THEN 1 ELSE 0 END AS f_gtin,
    CASE WHEN NOT {missing('len_v')} AND ({pyfloat('len_v')} IS NULL OR {pyfloat('len_v')} <= 0)
         THEN 1 ELSE 0 END AS f_len,
    CASE WHEN NOT {missing('mat_v')} AND mat_v NOT IN ({_DOMAIN}) THEN 1 ELSE 0 END AS f_mat
  FROM mapped)"""


def _gate_sql() -> str:
    return f"""WITH {MAPPED_SQL},
agg AS (
  SELECT client_id, ingest_id, count(*) AS total_rows,
         CAST(sum(f_sku + f_gtin + f_len) AS BIGINT) AS error_count,
         CAST(sum(f_mat) AS BIGINT) AS warning_count
  FROM checked GROUP BY client_id, ingest_id),
s AS (
  SELECT *, greatest(0.0, 1.0 - error_count * 0.1) AS completeness,
         greatest(0.0, 1.0 - error_count / CAST(total_rows AS DOUBLE)) AS validity,
         greatest(0.0, 1.0 - warning_count / CAST(total_rows AS DOUBLE)) AS consistency
  FROM agg)
SELECT client_id, ingest_id, total_rows, error_count, warning_count,
       {r6('completeness')} AS completeness, {r6('validity')} AS accuracy,
       {r6('consistency')} AS consistency, {r6('validity')} AS validity,
       {r6('(completeness + validity + consistency + validity) / 4.0')} AS overall_score,
       CASE WHEN error_count > 0 AND (completeness + validity + consistency + validity) / 4.0 < 0.8
            THEN 'FAIL' WHEN warning_count > 0 THEN 'WARN' ELSE 'PASS' END AS gate_status
FROM s"""


@register("a11_gate", _gate_sql())
def q_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: raw rows -> template -> all rules in one pass -> gate."""
    return round_doubles(quality.gate(validated_products(spark, sf_dir)))


@register("p01_map_products", f"""WITH {MAPPED_SQL}
SELECT client_id, ingest_id, row_num, sku, product_name, brand, gtin, price, currency,
       CAST((CASE WHEN len_v IS NULL THEN 0 ELSE 1 END)
          + (CASE WHEN mat_v IS NULL THEN 0 ELSE 1 END) AS INTEGER) AS n_features,
       CAST(n_map_issues AS INTEGER) AS n_issues
FROM mapped""")
def q_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template applied; product columns, feature and issue counts."""
    m = mapped_products(spark, sf_dir)
    return m.select(*KEYS, *[F.col(f"product.{c}").alias(c) for c in
                             ("sku", "product_name", "brand", "gtin", "price", "currency")],
                    F.size("features").alias("n_features"), F.size("issues").alias("n_issues"))


@register("v09_issues", f"""WITH {MAPPED_SQL},
long AS (
  SELECT client_id, ingest_id, row_num, 'Required SKU' AS rule_name, 'required' AS rule_type,
         'ERROR' AS severity, 'sku' AS target_name, sku AS value FROM checked WHERE f_sku = 1
  UNION ALL
  SELECT client_id, ingest_id, row_num, 'GTIN Format', 'format', 'ERROR', 'gtin', gtin
  FROM checked WHERE f_gtin = 1
  UNION ALL
  SELECT client_id, ingest_id, row_num, 'Positive Length', 'range', 'ERROR', 'EF001001', len_v
  FROM checked WHERE f_len = 1
  UNION ALL
  SELECT client_id, ingest_id, row_num, 'Valid Material', 'domain', 'WARN', 'EF001003', mat_v
  FROM checked WHERE f_mat = 1)
SELECT * FROM long""")
def q_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V01-V04 + V09: one row per (row, failed rule)."""
    return issues_long(validated_products(spark, sf_dir)).select(
        *KEYS, "rule_name", "rule_type", "severity", "target_name", "value")


@register("v10_severity_summary", f"""WITH {MAPPED_SQL}
SELECT client_id, ingest_id,
       CAST(sum(f_sku + f_gtin + f_len) AS BIGINT) AS error_count,
       CAST(sum(f_mat) AS BIGINT) AS warn_count, CAST(0 AS BIGINT) AS info_count
FROM checked GROUP BY client_id, ingest_id HAVING sum(f_sku + f_gtin + f_len + f_mat) > 0""")
def q_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ERROR / WARN / INFO counts per ingest."""
    return severity_summary(issues_long(validated_products(spark, sf_dir)))


# ---------------------------------------------------------------------------
# Compat mode: the reference's own semantics: the seeded GTIN
# pattern as written (``re.match`` of an unanchored alternation), required
# rules only on present fields, gate scores not clamped.
# ---------------------------------------------------------------------------
from vetrina.sources.reference_data import SEED_GTIN_PATTERN  # noqa: E402

COMPAT_CHECKED_SQL = MAPPED_SQL.replace(
    f"CASE WHEN {blank('sku')} THEN 1 ELSE 0 END AS f_sku",
    f"CASE WHEN sku IS NOT NULL AND {strip('sku')} = '' THEN 1 ELSE 0 END AS f_sku").replace(
    f"NOT regexp_full_match(gtin, '{_GTIN[1:-1]}')",
    f"NOT regexp_matches(gtin, '^(?:{SEED_GTIN_PATTERN})')")


@register("v09_issues_compat", f"""WITH {COMPAT_CHECKED_SQL},
long AS (
  SELECT client_id, ingest_id, row_num, 'Required SKU' AS rule_name, 'ERROR' AS severity FROM checked WHERE f_sku = 1
  UNION ALL SELECT client_id, ingest_id, row_num, 'GTIN Format', 'ERROR' FROM checked WHERE f_gtin = 1
  UNION ALL SELECT client_id, ingest_id, row_num, 'Positive Length', 'ERROR' FROM checked WHERE f_len = 1
  UNION ALL SELECT client_id, ingest_id, row_num, 'Valid Material', 'WARN' FROM checked WHERE f_mat = 1)
SELECT * FROM long""")
def q_issues_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V01-V04/V09 with the reference's semantics (compat mode)."""
    return issues_long(validated_products(spark, sf_dir, compat=True)).select(
        *KEYS, "rule_name", "severity")


@register("a11_gate_compat", f"""WITH {COMPAT_CHECKED_SQL},
agg AS (
  SELECT client_id, ingest_id, count(*) AS total_rows,
         CAST(sum(f_sku + f_gtin + f_len) AS BIGINT) AS error_count,
         CAST(sum(f_mat) AS BIGINT) AS warning_count
  FROM checked GROUP BY client_id, ingest_id),
s AS (
  SELECT *, greatest(0.0, 1.0 - error_count * 0.1) AS completeness,
         1.0 - error_count / CAST(total_rows AS DOUBLE) AS validity,
         1.0 - warning_count / CAST(total_rows AS DOUBLE) AS consistency
  FROM agg)
SELECT client_id, ingest_id, total_rows, error_count, warning_count,
       {r6('(completeness + validity + consistency + validity) / 4.0')} AS overall_score,
       CASE WHEN error_count > 0 AND (completeness + validity + consistency + validity) / 4.0 < 0.8
            THEN 'FAIL' WHEN warning_count > 0 THEN 'WARN' ELSE 'PASS' END AS gate_status
FROM s""")
def q_gate_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10/A11 with the reference's semantics (compat mode)."""
    g = quality.gate(validated_products(spark, sf_dir, compat=True), compat=True)
    return round_doubles(g.select("client_id", "ingest_id", "total_rows", "error_count", "warning_count",
                                  "overall_score", "gate_status"))
