"""Registered queries: mapping transforms (P04-P09), template choice and
assembly (P10, P11), extra rules (V05-V07) and rule suggestion (V11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetrina.operators.mapping import (FieldMapping, Template, apply_template,
                                       assemble_templates, catalogue_template, choose_templates)
from vetrina.operators.rules import issues_long, validate
from vetrina.operators.suggest import suggest_rules
from vetrina.plans.fixtures import RAW_PRODUCT_COLUMNS, raw_product, raw_product_sql
from vetrina.plans.registry import register, round_doubles
from vetrina.plans.sqlfrag import missing, pyfloat, r6, strip
from vetrina.sources.reference_data import etim_class_feature_df, uom_df
from vetrina.sources.tables import table

RP = raw_product_sql()

TRANSFORM_TEMPLATE = Template(
    field_mappings=[
        FieldMapping("Currency", "currency_code", "lookup",
                     {"lookup_table": {"euro": "EUR", "USD": "USD", "GBP": "GBP"}}),
        FieldMapping("Material", "material_code", "lookup",
                     {"lookup_table": {"Steel": "ST", "Brass": "BR"}, "default_value": "OTHER"}),
        FieldMapping("Price", "price_cents", "formula", {"formula": "{value} * 100"}),
        FieldMapping("Length", "length_calc", "formula", {"formula": "({value} * 2 - 1) / 4"}),
        FieldMapping("Name", "name_brand", "concat", {"columns": ["Brand"], "separator": " | "}),
        FieldMapping("Name", "name_word2", "split", {"separator": " ", "index": 1}),
        FieldMapping("GTIN", "gtin_dash", "regex", {"pattern": r"^(\d{3})(\d+)$", "replacement": r"\1-\2"}),
        FieldMapping("SKU", "sku_digits", "regex", {"pattern": r"[^0-9]", "replacement": ""}),
        FieldMapping("Length", "length_mm", "uom_convert", {"from_unit": "cm", "to_unit": "mm"}),
    ],
    feature_mappings=[], template_id="tmpl-transforms", client_id="global", name="transforms")

TRANSFORM_SQL = f"""WITH {RP}
SELECT row_num,
  CASE WHEN {missing('"Currency"')} THEN NULL
       WHEN {strip('"Currency"')} = 'euro' THEN 'EUR' WHEN {strip('"Currency"')} = 'USD' THEN 'USD'
       WHEN {strip('"Currency"')} = 'GBP' THEN 'GBP'
       WHEN lower({strip('"Currency"')}) = 'euro' THEN 'EUR' WHEN lower({strip('"Currency"')}) = 'usd' THEN 'USD'
       WHEN lower({strip('"Currency"')}) = 'gbp' THEN 'GBP' ELSE "Currency" END AS currency_code,
  CASE WHEN {missing('"Material"')} THEN NULL
       WHEN {strip('"Material"')} = 'Steel' THEN 'ST' WHEN {strip('"Material"')} = 'Brass' THEN 'BR'
       WHEN lower({strip('"Material"')}) = 'steel' THEN 'ST' WHEN lower({strip('"Material"')}) = 'brass' THEN 'BR'
       ELSE 'OTHER' END AS material_code,
  {r6(f"CASE WHEN {missing('\"Price\"')} THEN NULL WHEN {pyfloat('\"Price\"')} IS NOT NULL THEN {pyfloat('\"Price\"')} * 100 ELSE TRY_CAST(\"Price\" AS DOUBLE) END")} AS price_cents,
  {r6(f"CASE WHEN {missing('\"Length\"')} THEN NULL WHEN {pyfloat('\"Length\"')} IS NOT NULL THEN ({pyfloat('\"Length\"')} * 2 - 1) / 4 ELSE TRY_CAST(\"Length\" AS DOUBLE) END")} AS length_calc,
  CASE WHEN {missing('"Name"')} THEN NULL
       ELSE concat_ws(' | ', "Name", CASE WHEN "Brand" <> '' THEN "Brand" END) END AS name_brand,
  CASE WHEN {missing('"Name"')} THEN NULL WHEN len(string_split("Name", ' ')) > 1
       THEN {strip('string_split("Name", \' \')[2]')} ELSE "Name" END AS name_word2,
  CASE WHEN {missing('"GTIN"')} THEN NULL ELSE regexp_replace("GTIN", '^(\\d{{3}})(\\d+)$', '\\1-\\2') END AS gtin_dash,
  CASE WHEN {missing('"SKU"')} THEN NULL ELSE regexp_replace("SKU", '[^0-9]', '', 'g') END AS sku_digits,
  {r6(f"CASE WHEN {missing('\"Length\"')} THEN NULL ELSE {pyfloat('\"Length\"')} * 10 + 0 END")} AS length_mm,
  CAST(CASE WHEN NOT {missing('"Length"')} AND {pyfloat('"Length"')} IS NULL THEN 1 ELSE 0 END AS INTEGER) AS n_issues
FROM raw_product"""


@register("p04_p09_transforms", TRANSFORM_SQL)
def q_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P04 lookup, P05 formula, P06 concat, P07 split, P08 regex, P09 unit
    conversion: each a compiled Column, all applied in one select."""
    m = apply_template(raw_product(spark, sf_dir), TRANSFORM_TEMPLATE, uom=uom_df(spark))
    p = F.col("product")
    return round_doubles(m.select(
        "row_num", p["currency_code"].alias("currency_code"), p["material_code"].alias("material_code"),
        p["price_cents"].try_cast("double").alias("price_cents"),
        p["length_calc"].try_cast("double").alias("length_calc"),
        p["name_brand"].alias("name_brand"), p["name_word2"].alias("name_word2"),
        p["gtin_dash"].alias("gtin_dash"), p["sku_digits"].alias("sku_digits"),
        p["length_mm"].try_cast("double").alias("length_mm"),
        F.size("issues").alias("n_issues")))


# --------------------------------------------------------------------------
# P10 / P11 over orders and lineitem: an order stands for a template
# version of its customer (active while not finally closed), its line
# items for the template's field mappings.
# --------------------------------------------------------------------------
def _templates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("template_id"), F.col("o_custkey").alias("client_id"),
                    F.col("o_orderpriority").alias("name"),
                    F.year("o_orderdate").alias("version"),
                    (F.col("o_orderstatus") != "F").alias("is_active"))


@register("p10_template_choice", """
SELECT client_id, template_id, version FROM (
  SELECT o_orderkey AS template_id, o_custkey AS client_id, CAST(year(o_orderdate) AS INTEGER) AS version,
         row_number() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate) DESC, o_orderkey DESC) AS rn
  FROM orders WHERE o_orderstatus <> 'F')
WHERE rn = 1""")
def q_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: per client the active template with the highest version."""
    return choose_templates(_templates(spark, sf_dir)).select(
        "client_id", "template_id", "version")


@register("p11_template_assembly", """
SELECT o.o_orderkey AS template_id, o.o_custkey AS client_id,
       CAST(count(l.l_linenumber) AS BIGINT) AS n_field_mappings,
       string_agg(CAST(l.l_linenumber AS VARCHAR), ',' ORDER BY l.l_linenumber) AS field_order
FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey
GROUP BY o.o_orderkey, o.o_custkey""")
def q_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template with its mappings (pre-aggregate, then left join)."""
    t = _templates(spark, sf_dir)
    fields = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("template_id"), F.col("l_linenumber").alias("src_ordinal"),
        F.col("l_partkey").alias("src_column"))
    a = assemble_templates(t, fields, fields.limit(0))
    fm = F.col("field_mappings")
    n = F.coalesce(F.size(fm), F.lit(0))
    return a.select("template_id", "client_id", n.cast("bigint").alias("n_field_mappings"),
                    F.when(n > 0, F.array_join(F.transform(fm, lambda x: x["src_ordinal"].cast("string")), ","))
                    .alias("field_order"))


# --------------------------------------------------------------------------
# ETIM mandatory features, GTIN checksum, SKU format.
# --------------------------------------------------------------------------
CLASS_LOOKUP = {"SMALL": "EC000123", "MEDIUM": "EC000123", "LARGE": "EC000456", "STANDARD": "EC000001"}
FULL_TEMPLATE = Template(
    field_mappings=catalogue_template().field_mappings + [
        FieldMapping("p_type", "etim_class", "lookup", {"lookup_table": CLASS_LOOKUP})],
    feature_mappings=catalogue_template().feature_mappings, template_id="tmpl-full", client_id="global")
EXTRA_RULES = [
    {"rule_id": "etim-len", "name": "Length mandatory", "rule_type": "etim", "target_type": "feature",
     "target_name": "EF001001", "rule_config": {}, "severity": "ERROR"},
    {"rule_id": "etim-dia", "name": "Diameter mandatory", "rule_type": "etim", "target_type": "feature",
     "target_name": "EF001002", "rule_config": {}, "severity": "ERROR"},
    {"rule_id": "etim-pitch", "name": "Thread pitch mandatory", "rule_type": "etim", "target_type": "feature",
     "target_name": "EF001004", "rule_config": {}, "severity": "WARN"},
    {"rule_id": "gtin-check", "name": "GTIN checksum", "rule_type": "custom", "target_type": "field",
     "target_name": "gtin", "rule_config": {"custom_rule": "gtin_checksum"}, "severity": "ERROR"},
    {"rule_id": "sku-format", "name": "SKU format", "rule_type": "custom", "target_type": "field",
     "target_name": "sku", "rule_config": {"custom_rule": "sku_format", "allow_special_chars": ["_"]},
     "severity": "WARN"},
]

_G = strip('"GTIN"')
_CHECK = (f"list_sum(list_transform(range(0, length({_G}) - 1), lambda i: "
          f"TRY_CAST(substr({_G}, i + 1, 1) AS INTEGER) * CASE WHEN (length({_G}) - 2 - i) % 2 = 0 THEN 3 ELSE 1 END))")
_CLASS = ("CASE p_type WHEN 'SMALL' THEN 'EC000123' WHEN 'MEDIUM' THEN 'EC000123' "
          "WHEN 'LARGE' THEN 'EC000456' WHEN 'STANDARD' THEN 'EC000001' ELSE p_type END")
V05_SQL = f"""WITH {RP},
m AS (SELECT client_id, ingest_id, row_num, {_CLASS} AS etim_class, "GTIN", "SKU", "Length",
             CASE WHEN {missing('"SKU"')} THEN NULL ELSE {strip('"SKU"')} END AS sku_m
      FROM raw_product)
SELECT client_id, ingest_id, row_num, 'Diameter mandatory' AS rule_name, 'ERROR' AS severity
FROM m WHERE etim_class = 'EC000123'
UNION ALL
SELECT client_id, ingest_id, row_num, 'Thread pitch mandatory', 'WARN' FROM m WHERE etim_class = 'EC000123'
UNION ALL
SELECT client_id, ingest_id, row_num, 'Length mandatory', 'ERROR' FROM m
WHERE etim_class = 'EC000123' AND {missing('"Length"')}
UNION ALL
SELECT client_id, ingest_id, row_num, 'GTIN checksum', 'ERROR' FROM m
WHERE NOT {missing('"GTIN"')} AND NOT (regexp_full_match({_G}, '[0-9]+') AND length({_G}) IN (8, 12, 13, 14)
      AND (10 - {_CHECK} % 10) % 10 = TRY_CAST(substr({_G}, length({_G}), 1) AS INTEGER))
UNION ALL
SELECT client_id, ingest_id, row_num, 'SKU format', 'WARN' FROM m
WHERE NOT {missing('sku_m')} AND (length(sku_m) < 6 OR length(sku_m) > 20 OR NOT regexp_full_match(sku_m, '[A-Za-z0-9_]*'))"""


@register("v05_v07_etim_gtin_sku", V05_SQL)
def q_extra_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V05 class-mandatory features (broadcast class-feature join), V06 GTIN
    checksum (GS1 weights), V07 SKU format."""
    m = apply_template(raw_product(spark, sf_dir), FULL_TEMPLATE, uom=uom_df(spark))
    v = validate(m, EXTRA_RULES, class_features=etim_class_feature_df(spark))
    return issues_long(v).select("client_id", "ingest_id", "row_num", "rule_name", "severity")


# --------------------------------------------------------------------------
def _v11_sql() -> str:
    from vetrina.plans.q_profile import long_sql
    num = pyfloat("value")
    return f"""WITH {long_sql('raw_product', RAW_PRODUCT_COLUMNS, prefix=RP + ', ')},
st AS (SELECT "column", count(*) AS n,
         count(*) FILTER (WHERE NOT (value IS NULL OR {strip('value')} = '')) AS n_nonblank,
         count(*) FILTER (WHERE {num} IS NOT NULL) AS n_numeric, min({num}) AS vmin, max({num}) AS vmax,
         count(*) FILTER (WHERE value <> '') AS n_str,
         count(*) FILTER (WHERE value <> '' AND regexp_full_match(value, '[0-9]+') AND length(value) IN (8,12,13,14)) AS n_gtin,
         count(*) FILTER (WHERE value <> '' AND contains(value, '@') AND contains(value, '.')) AS n_email
       FROM long GROUP BY "column"),
vc AS (SELECT "column", count(DISTINCT value) AS n_distinct,
              string_agg(DISTINCT value, '|' ORDER BY value) AS vals
       FROM long WHERE value <> '' GROUP BY "column"),
s AS (SELECT st.*, coalesce(vc.n_distinct, 0) AS n_distinct, vc.vals FROM st LEFT JOIN vc USING ("column"))
SELECT "column", 'required' AS rule_type, 'ERROR' AS severity, CAST(0.9 AS DOUBLE) AS confidence,
       CAST(NULL AS DOUBLE) AS range_min, CAST(NULL AS DOUBLE) AS range_max, CAST(NULL AS VARCHAR) AS domain_values
FROM s WHERE n > 0 AND n_nonblank = n
UNION ALL
SELECT "column", 'range', 'WARN', CAST(0.8 AS DOUBLE),
       {r6('CASE WHEN vmin >= 0 THEN vmin * 0.8 ELSE vmin * 1.2 END')},
       {r6('CASE WHEN vmax >= 0 THEN vmax * 1.2 ELSE vmax * 0.8 END')}, NULL
FROM s WHERE n > 0 AND n_numeric > n * 0.8
UNION ALL
SELECT "column", 'gtin_format', 'ERROR', CAST(0.85 AS DOUBLE), NULL, NULL, NULL FROM s WHERE n_str > 0 AND n_gtin > n_str * 0.7
UNION ALL
SELECT "column", 'email_format', 'WARN', CAST(0.8 AS DOUBLE), NULL, NULL, NULL FROM s WHERE n_str > 0 AND n_email > n_str * 0.7
UNION ALL
SELECT "column", 'domain', 'WARN', CAST(0.7 AS DOUBLE), NULL, NULL, vals FROM s
WHERE n_str > 0 AND n_distinct <= 10 AND n_distinct < n_str * 0.5"""


@register("v11_rule_suggestions", _v11_sql())
def q_suggest_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule suggestions per column from all values of the file."""
    s = suggest_rules(raw_product(spark, sf_dir), RAW_PRODUCT_COLUMNS)
    return round_doubles(s.select("column", "rule_type", "severity", "confidence", "range_min", "range_max",
                                  F.array_join("domain_values", "|").alias("domain_values")))
