"""Registered queries: export filter, newest N, wide features, profiles and
the file sinks read back (P17, O01, R02, R03, R04, S11-S15)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetrina.operators import export as X
from vetrina.operators import resolve as R
from vetrina.operators.normalization import normalize_features
from vetrina.plans.fixtures import raw_product_sql
from vetrina.plans.q_normalize import FEATURE_BODY
from vetrina.plans.q_resolve import RESOLVE_BODY, RESOLVE_SQL, mapped_full, normalized_batch
from vetrina.plans.registry import register
from vetrina.session import materialize, scratch_path
from vetrina.sources.reference_data import etim_feature_df, uom_df

AS_OF = "2024-01-31 00:00:00"
CODES = ["EF001001", "EF001003"]


def catalogue(spark: SparkSession, sf_dir: str, features: bool = True) -> dict:
    """First import: records, products, crosswalk and, if asked, feature
    values."""
    mapped = mapped_full(spark, sf_dir)
    batch = normalized_batch(spark, sf_dir, mapped=mapped)
    recs = R.resolve(batch)["records"]
    out = {"records": recs, "products": R.upsert_products(recs), "crosswalk": R.upsert_crosswalk(recs)}
    if not features:
        return out
    nf = materialize(normalize_features(mapped, etim_feature_df(spark), uom_df(spark)), "features")
    feats = (nf.join(batch.select("client_id", "ingest_id", "row_num", "sku"), ["client_id", "ingest_id", "row_num"])
             .withColumn("value_normalized", F.coalesce(F.col("value_converted").cast("string"),
                                                        F.col("value_text"), F.col("value_bool").cast("string"))))
    return out | {"features": R.upsert_features(feats, recs)}


# Oracle: products (prod) and per-product feature values (pf) of the import.
CATALOGUE_SQL = f"""WITH {raw_product_sql()}, {FEATURE_BODY}, {RESOLVE_BODY},
pf AS (
  SELECT r.product_id, f.etim_feature,
         arg_max(coalesce(CAST(f.value_converted AS VARCHAR), f.value_text), f.row_num) AS value_normalized,
         arg_max(f.unit_normalized, f.row_num) AS unit_normalized
  FROM fconv f JOIN n ON f.client_id = n.client_id AND f.row_num = n.row_num
  JOIN r ON r.client_id = n.client_id AND r.sku_n = n.sku_n
  GROUP BY r.product_id, f.etim_feature)"""


@register("p17_export_filter", f"""{RESOLVE_SQL}
SELECT p.product_id, p.sku, p.brand FROM prod p
WHERE p.etim_class = 'EC000123'
  AND EXISTS (SELECT 1 FROM r WHERE r.product_id = p.product_id AND r.client_id = 'c1')""")
def q_export_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client semi-join on the crosswalk + class filter."""
    c = catalogue(spark, sf_dir, features=False)
    return X.export_filter(c["products"], c["crosswalk"], "c1", etim_class="EC000123").select(
        "product_id", "sku", "brand")


@register("o01_newest_products", f"""{RESOLVE_SQL}
SELECT product_id, sku, CAST(seq AS BIGINT) AS seq FROM prod ORDER BY seq DESC, product_id LIMIT 25""")
def q_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest N products (latest source row as recency); N is the
    export size, a feature of the operator."""
    c = catalogue(spark, sf_dir, features=False)
    seq = c["records"].groupBy("product_id").agg(F.max("last_row").cast("bigint").alias("seq"))
    return X.newest(c["products"].join(seq, "product_id"), 25, order_col="seq").select(
        "product_id", "sku", "seq")


@register("r02_features_wide", f"""{CATALOGUE_SQL}
SELECT p.product_id, p.sku, p.etim_class,
  max(CASE WHEN pf.etim_feature = 'EF001001' THEN pf.value_normalized END) AS feature_EF001001,
  max(CASE WHEN pf.etim_feature = 'EF001001' THEN pf.unit_normalized END) AS feature_EF001001_unit,
  max(CASE WHEN pf.etim_feature = 'EF001003' THEN pf.value_normalized END) AS feature_EF001003,
  max(CASE WHEN pf.etim_feature = 'EF001003' THEN pf.unit_normalized END) AS feature_EF001003_unit
FROM prod p LEFT JOIN pf ON p.product_id = pf.product_id
GROUP BY p.product_id, p.sku, p.etim_class""")
def q_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """etim_only profile, features pivoted on explicit codes."""
    c = catalogue(spark, sf_dir)
    return X.export_table(c["products"], X.feature_values(c["features"]), "etim_only", codes=CODES)


@register("r03_pricing_profile", f"""{RESOLVE_SQL}
SELECT product_id, sku, gtin, product_name, price, currency FROM prod""")
def q_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pricing profile columns."""
    return X.export_table(catalogue(spark, sf_dir, features=False)["products"], None, "pricing")


@register("r04_nested_features", f"""{CATALOGUE_SQL}
SELECT p.product_id, CAST(count(pf.etim_feature) AS INTEGER) AS n_features,
       string_agg(pf.etim_feature || '=' || coalesce(pf.value_normalized, ''), ';' ORDER BY pf.etim_feature)
         AS feature_list
FROM prod p LEFT JOIN pf ON p.product_id = pf.product_id GROUP BY p.product_id""")
def q_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested product documents, features sorted by code."""
    c = catalogue(spark, sf_dir)
    nested = X.nested_products(c["products"], X.feature_values(c["features"]))
    f = F.coalesce(F.col("features"), F.array())
    return nested.select(
        "product_id", F.size(f).cast("int").alias("n_features"),
        F.when(F.size(f) > 0, F.array_join(F.transform(f, lambda x: F.concat(
            x["etim_feature"], F.lit("="), F.coalesce(x["value_normalized"], F.lit("")))), ";"))
        .alias("feature_list"))


def written_export(spark: SparkSession, sf_dir: str, fmt: str, c: dict | None = None) -> tuple[str, str, str | None]:
    """Write one export format into the shared checkpoint folder."""
    c = c or catalogue(spark, sf_dir)
    feats = X.feature_values(c["features"])
    nested = X.nested_products(c["products"], feats)
    path = scratch_path(spark, f"export-{fmt}")
    if fmt == "bmecat":
        X.write_xml(X.bmecat_articles(nested, AS_OF), path, "BMECAT", "ARTICLE")
        X.bmecat_header(spark, "c-all", AS_OF).write.mode("overwrite").format("xml") \
            .option("rootTag", "BMECAT").option("rowTag", "HEADER").save(path + "-header")
        return path, "xml", "ARTICLE"
    if fmt == "etim":
        X.write_xml(X.etim_products(nested), path, "ETIM", "Product")
        return path, "xml", "Product"
    if fmt == "json":
        nested = materialize(nested, "nested-products")
        meta = nested.agg(F.count(F.lit(1)).alias("product_count")).select(
            F.lit("c-all").alias("client_id"), F.lit(AS_OF).alias("generated_at"), F.lit("json").alias("format"),
            F.lit("full").alias("profile"), F.lit(X.ETIM_VERSION).alias("etim_version"), "product_count")
        X.write_json(nested, meta, path)
        return path + "/products", "json", None
    X.write_csv(X.export_table(c["products"], feats, "full", CODES), path)
    return path, "csv", None


@register("s11_csv_export", f"""{CATALOGUE_SQL}
SELECT p.sku, p.gtin, CAST(p.price AS VARCHAR) AS price,
  max(CASE WHEN pf.etim_feature = 'EF001001' THEN pf.value_normalized END) AS feature_EF001001
FROM prod p LEFT JOIN pf ON p.product_id = pf.product_id GROUP BY p.sku, p.gtin, p.price""")
def q_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-profile CSV written, then read back (all strings)."""
    path, _, _ = written_export(spark, sf_dir, "csv")
    return spark.read.option("header", True).csv(path).select("sku", "gtin", "price", "feature_EF001001")


@register("s12_json_export", f"""{CATALOGUE_SQL}
SELECT p.sku, p.gtin, CAST(p.price AS DOUBLE) AS price,
  string_agg(pf.etim_feature || '=' || coalesce(pf.value_normalized, ''), ';' ORDER BY pf.etim_feature) AS feature_list,
  any_value('9.0') AS etim_version, (SELECT count(*) FROM prod) AS product_count
FROM prod p LEFT JOIN pf ON p.product_id = pf.product_id GROUP BY p.product_id, p.sku, p.gtin, p.price""")
def q_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines export with its features and metadata, read back."""
    path, _, _ = written_export(spark, sf_dir, "json")
    meta = spark.read.json(path.removesuffix("products") + "metadata").select("etim_version", "product_count", F.lit(1).alias("one"))
    feature = F.transform("features", lambda x: F.concat(x["etim_feature"], F.lit("="), F.coalesce(x["value_normalized"], F.lit(""))))
    return (spark.read.json(path).withColumn("one", F.lit(1)).join(F.broadcast(meta), "one")
            .select("sku", "gtin", F.col("price").cast("double").alias("price"), F.array_join(feature, ";").alias("feature_list"),
                    "etim_version", "product_count"))


# Features are written for classified products only.
_XML_FEATURES = """CASE WHEN p.etim_class <> '' THEN string_agg(pf.etim_feature || '=' || coalesce(pf.value_normalized, '') || ' ' || coalesce(pf.unit_normalized, ''), ';' ORDER BY pf.etim_feature) END"""


def _xml_features(features: str, code: str, value: str, unit: str):
    text = lambda x, c: F.coalesce(x[c], F.lit(""))
    return F.array_join(F.transform(features, lambda x: F.concat(x[code], F.lit("="), text(x, value), F.lit(" "), text(x, unit))), ";")


@register("s13_bmecat_xml", f"""{CATALOGUE_SQL}
SELECT p.sku AS supplier_aid, p.gtin AS ean, p.brand AS manufacturer, p.etim_class AS class_id,
       CASE WHEN p.price <> 0 THEN CAST(p.price AS VARCHAR) END AS price_amount, {_XML_FEATURES} AS feature_list
FROM prod p LEFT JOIN pf ON p.product_id = pf.product_id
GROUP BY p.product_id, p.sku, p.gtin, p.brand, p.etim_class, p.price""")
def q_bmecat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BMEcat ARTICLE elements written as XML and parsed back."""
    path, _, tag = written_export(spark, sf_dir, "bmecat")
    a = spark.read.format("xml").option("rowTag", tag).schema(
        "SUPPLIER_AID string, ARTICLE_DETAILS struct<EAN:string, MANUFACTURER_NAME:string, "
        "CLASSIFICATION_SYSTEM:struct<CLASSIFICATION_GROUP:struct<CLASSIFICATION_GROUP_ID:string>>, "
        "FEATURE_SYSTEM:struct<FEATURE:array<struct<FNAME:string, FVALUE:string, FUNIT:string>>>>, "
        "ARTICLE_PRICE_DETAILS struct<ARTICLE_PRICE:struct<PRICE_AMOUNT:string>>").load(path)
    return a.select(F.col("SUPPLIER_AID").alias("supplier_aid"),
                    F.col("ARTICLE_DETAILS.EAN").alias("ean"),
                    F.col("ARTICLE_DETAILS.MANUFACTURER_NAME").alias("manufacturer"),
                    F.col("ARTICLE_DETAILS.CLASSIFICATION_SYSTEM.CLASSIFICATION_GROUP.CLASSIFICATION_GROUP_ID")
                    .alias("class_id"),
                    F.col("ARTICLE_PRICE_DETAILS.ARTICLE_PRICE.PRICE_AMOUNT").alias("price_amount"),
                    _xml_features("ARTICLE_DETAILS.FEATURE_SYSTEM.FEATURE", "FNAME", "FVALUE", "FUNIT").alias("feature_list"))


@register("s14_etim_xml", f"""{CATALOGUE_SQL}
SELECT p.sku AS supplier_aid, p.gtin, p.product_name, p.brand, p.etim_class AS class_code, {_XML_FEATURES} AS feature_list
FROM prod p LEFT JOIN pf ON p.product_id = pf.product_id
GROUP BY p.product_id, p.sku, p.gtin, p.product_name, p.brand, p.etim_class""")
def q_etim_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ETIM Product elements written as XML and parsed back."""
    path, _, tag = written_export(spark, sf_dir, "etim")
    p = spark.read.format("xml").option("rowTag", tag).schema(
        "SupplierAID string, GTIN string, ProductName string, Brand string, ETIMClassification struct<ClassCode:string, "
        "Features:struct<Feature:array<struct<FeatureCode:string, Value:string, Unit:string>>>>").load(path)
    return p.select(F.col("SupplierAID").alias("supplier_aid"), F.col("GTIN").alias("gtin"), F.col("ProductName").alias("product_name"),
                    F.col("Brand").alias("brand"), F.col("ETIMClassification.ClassCode").alias("class_code"),
                    _xml_features("ETIMClassification.Features.Feature", "FeatureCode", "Value", "Unit").alias("feature_list"))


@register("s15_export_check", f"""{RESOLVE_SQL}
SELECT 'xml' AS format, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_corrupt, true AS valid FROM prod""")
def q_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Well-formedness and row count of a written export (file count
    and bytes depend on partitioning and are left out)."""
    c = catalogue(spark, sf_dir)
    path, fmt, tag = written_export(spark, sf_dir, "bmecat", c)
    expected = c["products"].count()
    return X.read_back_check(spark, path, fmt, expected, row_tag=tag).select("format", "n_rows", "n_corrupt", "valid")
