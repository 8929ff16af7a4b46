"""Registered queries: scalar normalisation (F01-F06, F12, F13) and record /
feature normalisation (F07-F11) over ``raw_product`` and driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetrina.functions import normalize as N
from vetrina.operators.normalization import normalize_features, normalize_products
from vetrina.plans.fixtures import raw_product, raw_product_sql
from vetrina.plans.q_validation import mapped_products
from vetrina.plans.registry import register
from vetrina.plans.sqlfrag import missing, strip
from vetrina.sources.reference_data import etim_feature_df, uom_df
from vetrina.sources.tables import table

KEYS = ["client_id", "ingest_id", "row_num"]
RP = raw_product_sql()


def sql_text(x: str) -> str:
    return f"regexp_replace({strip(f'coalesce({x}, {chr(39)}{chr(39)})')}, '\\s{{2,}}', ' ', 'g')"


def sql_numeric(x: str, p: int = 6) -> str:
    s = f"regexp_replace({strip(x)}, '[, ]', '', 'g')"
    s2 = f"(CASE WHEN regexp_full_match({s}, '[^.]*\\.[0-9]{{3}}') THEN replace({s}, '.', '') ELSE {s} END)"
    num = N.NUMBER_RE[1:-1]
    return (f"(CASE WHEN {missing(x)} THEN NULL WHEN regexp_full_match({s2}, '{num}') "
            f"THEN CAST(round_even(CAST({s2} AS DECIMAL(38,18)), {p}) AS DECIMAL(38,{p})) END)")


def sql_price(x: str) -> str:
    v = sql_numeric(x, 2)
    return f"(CASE WHEN {v} < 0 THEN CAST(0 AS DECIMAL(38,2)) ELSE {v} END)"


def sql_currency(x: str) -> str:
    u = f"upper({strip(x)})"
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in N.CURRENCY_NAMES.items())
    return f"(CASE WHEN {x} IS NULL THEN 'USD' ELSE (CASE {u} {whens} ELSE {u} END) END)"


def sql_gtin(x: str) -> str:
    d = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    return (f"(CASE WHEN {missing(x)} THEN NULL WHEN length({d}) IN (12, 13) THEN '0' || {d} "
            f"WHEN length({d}) IN (8, 14) THEN {d} END)")


def sql_bool(x: str) -> str:
    s = f"lower({strip(x)})"
    t = ", ".join(f"'{w}'" for w in N.TRUE_WORDS)
    f = ", ".join(f"'{w}'" for w in N.FALSE_WORDS)
    return f"(CASE WHEN {missing(x)} THEN NULL WHEN {s} IN ({t}) THEN TRUE WHEN {s} IN ({f}) THEN FALSE END)"


def sql_mapped(x: str) -> str:
    return f"(CASE WHEN {missing(x)} THEN NULL ELSE {strip(x)} END)"


# --------------------------------------------------------------------------
@register("f01_normalize_text", f"""WITH {RP}
SELECT row_num, {sql_text('"Name"')} AS name_norm, upper({sql_text('"SKU"')}) AS sku_norm,
       {sql_text('NULL')} AS null_norm
FROM raw_product""")
def q_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """strip + collapse whitespace runs, optional upper case; null -> ''."""
    r = raw_product(spark, sf_dir)
    return r.select("row_num", N.normalize_text("Name").alias("name_norm"),
                    N.normalize_text("SKU", case="upper").alias("sku_norm"),
                    N.normalize_text(F.lit(None).cast("string")).alias("null_norm"))


@register("f02_normalize_numeric", f"""WITH {RP}
SELECT row_num, "Length" AS length_raw, {sql_numeric('"Length"')} AS length_num,
       {sql_numeric('"Price"')} AS price_num
FROM raw_product""")
def q_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """decimal text -> DECIMAL(38,6), thousands marks, half-even."""
    r = raw_product(spark, sf_dir)
    return r.select("row_num", F.col("Length").alias("length_raw"),
                    N.normalize_numeric("Length").alias("length_num"),
                    N.normalize_numeric("Price").alias("price_num"))


@register("f03_normalize_price", f"""WITH {RP}
SELECT row_num, {sql_price('"Price"')} AS price, {sql_price('"Length"')} AS length_as_price
FROM raw_product""")
def q_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """two places; negatives clamp to 0.00."""
    r = raw_product(spark, sf_dir)
    return r.select("row_num", N.normalize_price("Price").alias("price"),
                    N.normalize_price("Length").alias("length_as_price"))


@register("f04_normalize_currency", f"""WITH {RP}
SELECT row_num, "Currency" AS currency_raw, {sql_currency('"Currency"')} AS currency
FROM raw_product""")
def q_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """null -> USD, upper, currency names -> codes."""
    r = raw_product(spark, sf_dir)
    return r.select("row_num", F.col("Currency").alias("currency_raw"),
                    N.normalize_currency("Currency").alias("currency"))


@register("f05_normalize_gtin", f"""WITH {RP}
SELECT row_num, "GTIN" AS gtin_raw, {sql_gtin('"GTIN"')} AS gtin FROM raw_product""")
def q_gtin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """digits only; 8/12/13/14 digits; 12 and 13 get one leading zero."""
    r = raw_product(spark, sf_dir)
    return r.select("row_num", F.col("GTIN").alias("gtin_raw"), N.normalize_gtin("GTIN").alias("gtin"))


@register("f06_normalize_boolean", f"""
SELECT doc_id, {sql_bool('CAST(quality AS VARCHAR)')} AS quality_flag,
       {sql_bool("CASE WHEN toxic = 1 THEN ' Yes ' ELSE 'nein' END")} AS toxic_flag
FROM labels""")
def q_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """multilingual yes/no words -> boolean (labels as text flags)."""
    lab = table(spark, sf_dir, "labels")
    return lab.select("doc_id", N.normalize_boolean(F.col("quality").cast("string")).alias("quality_flag"),
                      N.normalize_boolean(F.when(F.col("toxic") == 1, " Yes ").otherwise("nein"))
                      .alias("toxic_flag"))


@register("f12_numeric_test", f"""WITH {RP}
SELECT row_num,
  (CASE WHEN regexp_full_match({strip('replace("Length", \',\', \'\')')}, '{N.NUMBER_RE[1:-1]}')
        THEN TRUE ELSE FALSE END) AS length_is_numeric,
  (CASE WHEN regexp_full_match({strip('replace("GTIN", \',\', \'\')')}, '{N.NUMBER_RE[1:-1]}')
        THEN TRUE ELSE FALSE END) AS gtin_is_numeric
FROM raw_product""")
def q_is_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python float() after dropping commas (the profiler's test)."""
    r = raw_product(spark, sf_dir)
    return r.select("row_num", N.is_numeric_text("Length").alias("length_is_numeric"),
                    N.is_numeric_text("GTIN").alias("gtin_is_numeric"))


@register("f13_date_like", r"""
SELECT o_orderkey,
  regexp_matches(CAST(o_orderdate AS VARCHAR), '^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})') AS iso_like,
  regexp_matches(strftime(o_orderdate, '%d.%m.%Y'), '^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})') AS dotted_like,
  regexp_matches(o_orderpriority, '^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})') AS priority_like
FROM orders""")
def q_date_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """value starts with YYYY-MM-DD, MM/DD/YYYY or DD.MM.YYYY."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey",
                    N.is_date_like(F.col("o_orderdate").cast("string")).alias("iso_like"),
                    N.is_date_like(F.date_format("o_orderdate", "dd.MM.yyyy")).alias("dotted_like"),
                    N.is_date_like("o_orderpriority").alias("priority_like"))


# --------------------------------------------------------------------------
F10_SQL = f"""WITH {RP}
SELECT client_id, ingest_id, row_num,
  CASE WHEN {missing('"SKU"')} THEN NULL ELSE upper({sql_text(sql_mapped('"SKU"'))}) END AS sku,
  {sql_gtin(sql_mapped('"GTIN"'))} AS gtin,
  CASE WHEN {missing('"Name"')} THEN NULL ELSE {sql_text(sql_mapped('"Name"'))} END AS product_name,
  CASE WHEN {missing('"Brand"')} THEN NULL ELSE {sql_text(sql_mapped('"Brand"'))} END AS brand,
  {sql_price(sql_mapped('"Price"'))} AS price,
  CASE WHEN {missing('"Currency"')} THEN NULL ELSE {sql_currency(sql_mapped('"Currency"'))} END AS currency
FROM raw_product"""


@register("f10_normalize_products", F10_SQL)
def q_norm_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product record normalisation after mapping."""
    return normalize_products(mapped_products(spark, sf_dir)).select(
        *KEYS, "sku", "gtin", "product_name", "brand", "price", "currency")


_UNITS_SQL = """units(unit_raw, standard_unit, factor) AS (VALUES
  ('mm', 'cm', 0.1), ('cm', 'mm', 10.0), ('m', 'mm', 1000.0), ('kg', 'g', 1000.0),
  ('g', 'kg', 0.001), ('lb', 'kg', 0.453592), ('in', 'mm', 25.4), ('ft', 'mm', 304.8),
  ('lb', 'g', 453.592), ('oz', 'g', 28.3495), ('l', 'ml', 1000.0), ('gal', 'ml', 3785.41),
  ('qt', 'ml', 946.353))"""

FEATURE_BODY = f"""{_UNITS_SQL},
feats AS (
  SELECT client_id, ingest_id, row_num, 'EF001001' AS etim_feature, "Length" AS value_raw,
         "Length_Unit" AS unit_raw, 'N' AS data_type, 'mm' AS standard_unit,
         {sql_numeric(strip('"Length"'))} AS value_number, CAST(NULL AS VARCHAR) AS value_text
  FROM raw_product WHERE NOT {missing('"Length"')}
  UNION ALL
  SELECT client_id, ingest_id, row_num, 'EF001003', "Material", NULL, 'A', '',
         NULL, {sql_text(strip('"Material"'))}
  FROM raw_product WHERE NOT {missing('"Material"')}),
fconv AS (
  SELECT f.client_id, f.ingest_id, f.row_num, f.etim_feature, f.value_raw, f.unit_raw, f.data_type,
    f.value_number, f.value_text, CAST(NULL AS BOOLEAN) AS value_bool,
    CASE WHEN coalesce(f.unit_raw, '') = '' OR coalesce(f.standard_unit, '') = '' THEN f.value_number
         WHEN f.unit_raw = f.standard_unit OR f.value_number IS NULL OR f.value_number = 0 THEN f.value_number
         WHEN u.factor IS NOT NULL THEN CAST(round_even(f.value_number * CAST(u.factor AS DECIMAL(38,18)), 6) AS DECIMAL(38,6))
         ELSE f.value_number END AS value_converted,
    CASE WHEN coalesce(f.unit_raw, '') = '' OR coalesce(f.standard_unit, '') = '' THEN f.unit_raw
         WHEN f.unit_raw = f.standard_unit OR f.value_number IS NULL OR f.value_number = 0
              OR u.factor IS NOT NULL THEN f.standard_unit
         ELSE f.unit_raw END AS unit_normalized
  FROM feats f LEFT JOIN units u ON f.unit_raw = u.unit_raw AND f.standard_unit = u.standard_unit)"""

F11_SQL = f"""WITH {RP}, {FEATURE_BODY}
SELECT client_id, ingest_id, row_num, etim_feature, value_raw, unit_raw, data_type, value_number,
       value_text, value_bool, value_converted, unit_normalized FROM fconv"""


@register("f11_normalize_features", F11_SQL)
def q_norm_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """typed feature values with unit conversion (long form)."""
    nf = normalize_features(mapped_products(spark, sf_dir), etim_feature_df(spark), uom_df(spark))
    return nf.select(*KEYS, "etim_feature", "value_raw", "unit_raw", "data_type", "value_number",
                     "value_text", "value_bool", "value_converted", "unit_normalized")


# Compat: the reference's feature normalisation -- the raw value is typed
# (mapping transforms are lost), only the seeded unit table is consulted
# (no inch conversion), offsets are ignored.
F11_COMPAT_SQL = (F11_SQL.replace(_UNITS_SQL, """units(unit_raw, standard_unit, factor) AS (VALUES
  ('mm', 'cm', 0.1), ('cm', 'mm', 10.0), ('m', 'mm', 1000.0), ('kg', 'g', 1000.0),
  ('g', 'kg', 0.001), ('lb', 'kg', 0.453592))""")
                  .replace(sql_numeric(strip('"Length"')), sql_numeric('"Length"'))
                  .replace(sql_text(strip('"Material"')), sql_text('"Material"')))


@register("f11_normalize_features_compat", F11_COMPAT_SQL)
def q_norm_features_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F07/F08/F11 with the reference's semantics (compat mode)."""
    nf = normalize_features(mapped_products(spark, sf_dir), etim_feature_df(spark),
                            uom_df(spark, with_builtin=False), compat=True)
    return nf.select(*KEYS, "etim_feature", "value_raw", "unit_raw", "data_type", "value_number",
                     "value_text", "value_bool", "value_converted", "unit_normalized")
