"""Catalogue export.

Plan: filter products (pushed to the scan) -> client semi-join on the
crosswalk -> optional newest-N -> features joined once (sort-merge on
product_id, then ``collect_list`` per product: one product's features are
bounded by the class's feature count) -> wide pivot or nested struct ->
distributed write -> read-back check.

The reference builds one XML document in memory.  Spark writes one root per
part file; the catalogue header goes to its own one-row file.  A single
file needs ``coalesce(1)`` and is only offered for small exports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference.
# ---------------------------------------------------------------------------
BASE_COLUMNS = ["sku", "gtin", "product_name", "brand", "description", "etim_class"]
FULL_EXTRA = ["category", "manufacturer", "model", "price", "currency",
              "length", "width", "height", "diameter", "weight"]
PROFILES = {
    "standard": BASE_COLUMNS + ["price", "currency"],
    "full": BASE_COLUMNS + FULL_EXTRA,
    "etim_only": ["sku", "etim_class"],
    "pricing": ["sku", "gtin", "product_name", "price", "currency"],
}
FEATURE_PROFILES = ("full", "etim_only")
ETIM_VERSION = "9.0"
DEFAULT_TAX = "0.19"
DEFAULT_CURRENCY = "EUR"


def export_filter(products: DataFrame, crosswalk: DataFrame | None, client_id: str,
                  etim_class: str | None = None, brand: str | None = None,
                  updated_since=None) -> DataFrame:
    """Active products of a client (EXISTS on the crosswalk as a
    ``left_semi`` join; ``global`` sees all) with optional equality and
    recency filters; ``updated_since`` is a time or a column."""
    p = products.filter(F.coalesce(F.col("status"), F.lit("active")) == "active")
    if etim_class:
        p = p.filter(F.col("etim_class") == etim_class)
    if brand:
        p = p.filter(F.col("brand") == brand)
    if updated_since is not None:
        if "updated_at" not in products.columns:  # snapshots have it when written with the time of their import
            raise ValueError("updated_since needs products with updated_at")
        p = p.filter(F.col("updated_at") >= F.lit(updated_since).cast("timestamp"))
    if client_id != "global" and crosswalk is not None:
        cw = crosswalk.filter(F.col("client_id") == client_id).select("product_id")
        p = p.join(cw, "product_id", "left_semi")
    return p


def newest(products: DataFrame, n: int, order_col: str = "updated_at") -> DataFrame:
    """The newest ``n`` products; product_id breaks ties so the cut is
    deterministic.  The caller's limit is the feature; Spark plans it as a
    distributed top-k (TakeOrderedAndProject)."""
    return products.orderBy(F.col(order_col).desc(), F.col("product_id")).limit(n)


def feature_values(features: DataFrame) -> DataFrame:
    """Long feature values with one printable normalised value."""
    v = F.coalesce(F.col("value_converted").cast("string"), F.col("value_text"),
                   F.col("value_bool").cast("string")) if "value_converted" in features.columns \
        else F.col("value_normalized").cast("string")
    return features.select("product_id", "etim_feature", v.alias("value_normalized"),
                           "unit_normalized")


def features_wide(features: DataFrame, codes: list[str]) -> DataFrame:
    """Long -> wide ``feature_X`` / ``feature_X_unit`` columns, sorted.

    The feature codes are passed explicitly (from class-features), so the
    pivot needs no extra job to find distinct values and no 10 000-value cap."""
    codes = sorted(codes)
    piv = (features.groupBy("product_id").pivot("etim_feature", codes)
           .agg(F.first("value_normalized").alias("v"), F.first("unit_normalized").alias("u")))
    cols = []
    for c in codes:
        if len(codes) == 1:
            cols += [F.col("v").alias(f"feature_{c}"), F.col("u").alias(f"feature_{c}_unit")]
        else:
            cols += [F.col(f"{c}_v").alias(f"feature_{c}"), F.col(f"{c}_u").alias(f"feature_{c}_unit")]
    names = sorted([f"feature_{c}" for c in codes] + [f"feature_{c}_unit" for c in codes])
    return piv.select("product_id", *cols).select("product_id", *names)


def export_table(products: DataFrame, features: DataFrame | None, profile: str = "standard",
                 codes: list[str] | None = None) -> DataFrame:
    """The CSV / table view of an export profile (missing -> null)."""
    cols = PROFILES.get(profile, PROFILES["standard"])
    sel = [F.col(c) if c in products.columns else F.lit(None).cast("string").alias(c) for c in cols]
    out = products.select("product_id", *sel)
    if profile in FEATURE_PROFILES and features is not None and codes:
        out = out.join(features_wide(features, codes), "product_id", "left")
    return out


def nested_products(products: DataFrame, features: DataFrame) -> DataFrame:
    """Product + its features (sorted by code) as one nested row.

    Features are grouped per product before the join (one row per product
    on each side); the array holds one product's features only."""
    f = features.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("etim_feature"), F.col("value_normalized"), F.col("unit_normalized")))).alias("features"))
    return products.join(f, "product_id", "left")


def bmecat_articles(nested: DataFrame, as_of: str) -> DataFrame:
    """One ARTICLE row per product in the BMEcat layout."""
    date, time = as_of[:10], as_of[11:19]
    has_class = F.col("etim_class").isNotNull() & (F.col("etim_class") != "")
    feats = F.coalesce(F.col("features"), F.array())
    return nested.select(
        F.col("sku").alias("SUPPLIER_AID"),
        F.struct(
            F.col("product_name").alias("DESCRIPTION_SHORT"),
            F.col("description").alias("DESCRIPTION_LONG"),
            F.col("gtin").alias("EAN"),
            F.col("brand").alias("MANUFACTURER_NAME"),
            F.col("model").alias("MANUFACTURER_AID"),
            F.when(has_class, F.struct(
                F.lit("ETIM").alias("CLASSIFICATION_SYSTEM_NAME"),
                F.lit(ETIM_VERSION).alias("CLASSIFICATION_SYSTEM_VERSION"),
                F.struct(F.col("etim_class").alias("CLASSIFICATION_GROUP_ID")).alias("CLASSIFICATION_GROUP")))
            .alias("CLASSIFICATION_SYSTEM"),
            F.when(has_class & (F.size(feats) > 0), F.struct(
                F.lit("ETIM").alias("FEATURE_SYSTEM_NAME"),
                F.transform(feats, lambda x: F.struct(x["etim_feature"].alias("FNAME"),
                                                      x["value_normalized"].alias("FVALUE"),
                                                      x["unit_normalized"].alias("FUNIT"))).alias("FEATURE")))
            .alias("FEATURE_SYSTEM")).alias("ARTICLE_DETAILS"),
        F.struct(F.lit("PCE").alias("ORDER_UNIT"), F.lit("1").alias("CONTENT_UNIT")).alias("ARTICLE_ORDER_DETAILS"),
        F.when(F.col("price").isNotNull() & (F.col("price") != 0), F.struct(
            F.struct(F.lit(date).alias("DATE"), F.lit(time).alias("TIME")).alias("DATETIME"),
            F.struct(F.col("price").cast("string").alias("PRICE_AMOUNT"),
                     F.coalesce(F.col("currency"), F.lit(DEFAULT_CURRENCY)).alias("PRICE_CURRENCY"),
                     F.lit(DEFAULT_TAX).alias("TAX")).alias("ARTICLE_PRICE")))
        .alias("ARTICLE_PRICE_DETAILS"))


def bmecat_header(spark: SparkSession, client_id: str, as_of: str) -> DataFrame:
    """S13 header block (one row), written beside the article parts."""
    day = as_of[:10].replace("-", "")
    return spark.createDataFrame([(
        ("en", f"{client_id}-{day}", "1.0", f"Product Catalog - {client_id}", as_of[:10], DEFAULT_CURRENCY),
        (client_id, client_id.title()))],
        "CATALOG struct<LANGUAGE:string, CATALOG_ID:string, CATALOG_VERSION:string, CATALOG_NAME:string, "
        "CATALOG_DATE:string, CURRENCY:string>, SUPPLIER struct<SUPPLIER_ID:string, SUPPLIER_NAME:string>")


def etim_products(nested: DataFrame) -> DataFrame:
    """Product / ETIMClassification / Features layout."""
    has_class = F.col("etim_class").isNotNull() & (F.col("etim_class") != "")
    feats = F.coalesce(F.col("features"), F.array())
    return nested.select(
        F.col("sku").alias("SupplierAID"), F.col("gtin").alias("GTIN"),
        F.col("product_name").alias("ProductName"), F.col("brand").alias("Brand"),
        F.when(has_class, F.struct(
            F.col("etim_class").alias("ClassCode"),
            F.when(F.size(feats) > 0, F.struct(F.transform(feats, lambda x: F.struct(
                x["etim_feature"].alias("FeatureCode"), x["value_normalized"].alias("Value"),
                x["unit_normalized"].alias("Unit"))).alias("Feature"))).alias("Features")))
        .alias("ETIMClassification"))


def write_csv(df: DataFrame, path: str) -> str:
    """Header + rows, one file per partition."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_json(df: DataFrame, meta: DataFrame, path: str) -> str:
    """Products as JSON lines plus a one-row metadata data set."""
    df.write.mode("overwrite").json(f"{path}/products")
    meta.write.mode("overwrite").json(f"{path}/metadata")
    return path


def write_xml(df: DataFrame, path: str, root_tag: str, row_tag: str) -> str:
    """Distributed XML (one root element per part file)."""
    df.write.mode("overwrite").format("xml").option("rootTag", root_tag).option("rowTag", row_tag).save(path)
    return path


def read_back_check(spark: SparkSession, path: str, fmt: str, expected_rows: int | None = None,
                    row_tag: str | None = None, warn_bytes: int = 100 * 1024 * 1024) -> DataFrame:
    """Parse the written export back (PERMISSIVE, corrupt-record
    column), count rows and malformed rows, sum the file sizes, and report
    ``valid`` / warnings like the reference's check."""
    reader = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    if fmt == "xml":
        df = reader.format("xml").option("rowTag", row_tag).option("inferSchema", False).load(path)
    elif fmt == "json":
        df = reader.json(path)
    else:
        df = reader.option("header", True).csv(path)
    has_corrupt = "_corrupt" in df.columns
    stats = df.agg(F.count("*").alias("n_rows"),
                   (F.count_if(F.col("_corrupt").isNotNull()) if has_corrupt else F.lit(0)).alias("n_corrupt"))
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "part-*").load(path).select("length")).agg(
        F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"), F.count("*").alias("n_files"))
    # Both sides are single-row aggregates; join them on a constant key.
    out = stats.withColumn("__k", F.lit(1)).join(files.withColumn("__k", F.lit(1)), "__k").drop("__k")
    exp = F.lit(expected_rows) if expected_rows is not None else F.col("n_rows")
    return out.select(
        F.lit(fmt).alias("format"), "n_rows", F.col("n_corrupt").cast("bigint").alias("n_corrupt"),
        "n_files", "n_bytes",
        ((F.col("n_corrupt") == 0) & (F.col("n_rows") == exp)).alias("valid"),
        (F.col("n_bytes") > warn_bytes).alias("size_warning"))
