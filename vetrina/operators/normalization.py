"""Record and feature normalisation.

The reference looks up feature metadata and unit factors once per value
(N+1 queries).  Here both are reference-data joins: the feature table and
the unit table are broadcast (after a size check) and joined to the
exploded feature rows, so normalisation is one narrow stage plus two
broadcast hash joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetrina.functions.normalize import (normalize_currency, normalize_gtin, normalize_numeric,
                                         normalize_price, normalize_text, typed_value)

PRICE_FIELDS = ("price", "list_price", "cost_price")
DIMENSION_FIELDS = ("length", "width", "height", "diameter", "weight")


def normalize_product_struct(p) -> list:
    """one normalised column per product field (absent stays null)."""
    def keep(name, expr):
        return F.when(p[name].isNotNull(), expr).alias(name)
    cols = [
        keep("sku", normalize_text(p["sku"], case="upper")),
        keep("gtin", normalize_gtin(p["gtin"])),
        keep("product_name", normalize_text(p["product_name"])),
        keep("brand", normalize_text(p["brand"])),
        p["model"].alias("model"), p["description"].alias("description"),
        p["etim_class"].alias("etim_class"),
        *[keep(f, normalize_price(p[f])) for f in PRICE_FIELDS],
        keep("currency", normalize_currency(p["currency"])),
        *[keep(f, normalize_numeric(p[f])) for f in DIMENSION_FIELDS],
    ]
    return cols


def normalize_products(mapped: DataFrame) -> DataFrame:
    """F10 over mapped rows: keys + normalised product columns."""
    keys = [c for c in mapped.columns if c not in ("product", "features", "issues", "rule_issues")
            and not c.startswith("n_")]
    return mapped.select(*keys, *normalize_product_struct(F.col("product")))


def features_long(mapped: DataFrame) -> DataFrame:
    """Features array -> one row per (row, feature position)."""
    keys = [c for c in mapped.columns if c not in ("product", "features", "issues", "rule_issues")
            and not c.startswith("n_")]
    # posexplode_outer + filter: see rules.explode_computed.
    return (mapped.select(*keys, F.col("product.etim_class").alias("etim_class"),
                          F.posexplode_outer("features").alias("pos", "f"))
            .filter(F.col("f").isNotNull())
            .select(*keys, "etim_class", "pos", "f.*"))


def normalize_features(mapped: DataFrame, etim_features: DataFrame, uom: DataFrame,
                       compat: bool = False) -> DataFrame:
    """F07 + F08 + F11: typed, unit-converted feature values (long form).

    * value source: ``value_raw`` in compat, else the transformed value when
      present (mapping transforms are kept, SURVEY 3.5 #6);
    * conversion applies when the row has a unit and the feature a
      standard unit; same unit or a zero value -> unchanged with the
      standard unit; a known pair -> value * factor (+ offset unless
      compat); no pair -> unchanged with the source unit.
    """
    fl = features_long(mapped)
    info = etim_features.select(
        F.col("feature_code").alias("etim_feature"), "data_type",
        F.col("unit").alias("standard_unit"))
    units = uom.filter(F.coalesce(F.col("is_active"), F.lit(True))).select(
        F.col("source_unit").alias("unit_raw"), F.col("target_unit").alias("standard_unit"),
        "conversion_factor", "conversion_offset")
    src = F.col("value_raw") if compat else F.coalesce(F.col("value_transformed"), F.col("value_raw"))
    j = (fl.join(info, "etim_feature", "left")
           .withColumn("typed", typed_value(src, F.col("data_type")))
           .join(units, ["unit_raw", "standard_unit"], "left"))
    num = F.col("typed.value_number")
    has_units = (F.col("unit_raw").isNotNull() & (F.col("unit_raw") != "")
                 & F.col("standard_unit").isNotNull() & (F.col("standard_unit") != ""))
    same_or_zero = (F.col("unit_raw") == F.col("standard_unit")) | num.isNull() | (num == 0)
    factor = F.col("conversion_factor").cast("decimal(38,18)")
    offset = F.lit(0) if compat else F.coalesce(F.col("conversion_offset"), F.lit(0)).cast("decimal(38,18)")
    converted = F.bround(num * factor + offset, 6).cast("decimal(38,6)")
    value_converted = (F.when(~has_units | same_or_zero, num)
                        .when(factor.isNotNull(), converted)
                        .otherwise(num))
    unit_norm = (F.when(~has_units, F.col("unit_raw"))
                  .when(same_or_zero | factor.isNotNull(), F.col("standard_unit"))
                  .otherwise(F.col("unit_raw")))
    keys = [c for c in fl.columns if c not in ("etim_class", "pos", "etim_feature", "value_raw",
                                                "unit_raw", "value_transformed", "source_column")]
    return j.select(
        *keys, "pos", "etim_feature", "value_raw", "unit_raw", "value_transformed", "source_column",
        F.col("typed.data_type").alias("data_type"),
        F.col("typed.value_number").alias("value_number"),
        F.col("typed.value_text").alias("value_text"),
        F.col("typed.value_bool").alias("value_bool"),
        value_converted.cast("decimal(38,6)").alias("value_converted"),
        unit_norm.alias("unit_normalized"))
