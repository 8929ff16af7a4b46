"""S17 reference data: ETIM classes, features, class-features, units,
validation rules and the demo mapping template, as small DataFrames.

These tables are dimensions: bounded in size, joined by broadcast.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from vetrina.sources.tables import local_rows

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference seeds (kept verbatim, in order).
# ---------------------------------------------------------------------------
ETIM_CLASSES = [
    ("EC000001", "Fastener", None, "General fastening elements", None),
    ("EC000123", "Screw", None, "Threaded fasteners", None),
    ("EC000456", "Bolt", None, "Threaded fasteners with nuts", None),
]
ETIM_FEATURES = [
    ("EF001001", "Length", "N", "mm", "Overall length", None),
    ("EF001002", "Diameter", "N", "mm", "Nominal diameter", None),
    ("EF001003", "Material", "A", "", "Material designation", None),
    ("EF001004", "Thread pitch", "N", "mm", "Distance between threads", None),
    ("EF001005", "Head type", "A", "", "Type of screw head", None),
]
ETIM_CLASS_FEATURES = [
    ("EC000123", "EF001001", True, 1),
    ("EC000123", "EF001002", True, 2),
    ("EC000123", "EF001003", False, 3),
    ("EC000123", "EF001004", True, 4),
    ("EC000123", "EF001005", False, 5),
]
# (source_unit, target_unit, conversion_factor, conversion_offset, unit_type)
UOM_SEEDS = [
    ("mm", "cm", "0.1", "0", "length"),
    ("cm", "mm", "10.0", "0", "length"),
    ("m", "mm", "1000.0", "0", "length"),
    ("kg", "g", "1000.0", "0", "weight"),
    ("g", "kg", "0.001", "0", "weight"),
    ("lb", "kg", "0.453592", "0", "weight"),
]
# Built-in conversion table of the normaliser (F09); used as fallback rows
# beneath the seeded table.
UOM_BUILTIN = [
    ("m", "mm", "1000.0", "0", "length"),
    ("cm", "mm", "10.0", "0", "length"),
    ("in", "mm", "25.4", "0", "length"),
    ("ft", "mm", "304.8", "0", "length"),
    ("kg", "g", "1000.0", "0", "weight"),
    ("lb", "g", "453.592", "0", "weight"),
    ("oz", "g", "28.3495", "0", "weight"),
    ("l", "ml", "1000.0", "0", "volume"),
    ("gal", "ml", "3785.41", "0", "volume"),
    ("qt", "ml", "946.353", "0", "volume"),
]
# Seeded validation rules: (name, description, rule_type, target_type,
# target_name, rule_config, severity).  The GTIN pattern is the seed text.
SEED_GTIN_PATTERN = r"^\d{8}|\d{12}|\d{13}|\d{14}$"
# Corrected form (anchored alternation), the default here.
ANCHORED_GTIN_PATTERN = r"^(?:\d{8}|\d{12}|\d{13}|\d{14})$"
MATERIAL_DOMAIN = ["Steel", "Stainless Steel", "Brass", "Aluminum"]


def seed_rules(compat: bool = False) -> list[dict]:
    """The four seeded validation rules as driver-side metadata."""
    gtin = SEED_GTIN_PATTERN if compat else ANCHORED_GTIN_PATTERN
    rows = [
        ("Required SKU", "Product SKU must be present", "required", "field", "sku", {}, "ERROR"),
        ("GTIN Format", "GTIN must be 8, 12, 13, or 14 digits", "format", "field", "gtin",
         {"pattern": gtin}, "ERROR"),
        ("Positive Length", "Length must be positive", "range", "feature", "EF001001",
         {"min": 0, "exclusive_min": True}, "ERROR"),
        ("Valid Material", "Material must be from approved list", "domain", "feature", "EF001003",
         {"values": list(MATERIAL_DOMAIN)}, "WARN"),
    ]
    return [
        {"rule_id": f"rule-{i + 1}", "name": n, "description": d, "rule_type": rt,
         "target_type": tt, "target_name": tn, "rule_config": cfg, "severity": sev,
         "is_active": True}
        for i, (n, d, rt, tt, tn, cfg, sev) in enumerate(rows)
    ]


RULE_SCHEMA = T.StructType([
    T.StructField("rule_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("rule_type", T.StringType()),
    T.StructField("target_type", T.StringType()),
    T.StructField("target_name", T.StringType()),
    T.StructField("rule_config", T.StringType()),   # JSON text
    T.StructField("severity", T.StringType()),
    T.StructField("is_active", T.BooleanType()),
])


def rules_df(spark: SparkSession, rules: list[dict] | None = None) -> DataFrame:
    rules = rules if rules is not None else seed_rules()
    return local_rows(
        spark, [(r["rule_id"], r["name"], r.get("description"), r["rule_type"], r["target_type"],
                 r["target_name"], json.dumps(r.get("rule_config") or {}), r["severity"],
                 r.get("is_active", True)) for r in rules],
        RULE_SCHEMA)


def etim_class_df(spark: SparkSession) -> DataFrame:
    return local_rows(
        spark, ETIM_CLASSES, "class_code string, class_name string, parent_class string, "
                      "description string, version string")


def etim_feature_df(spark: SparkSession) -> DataFrame:
    return local_rows(
        spark, ETIM_FEATURES, "feature_code string, feature_name string, data_type string, "
                       "unit string, description string, value_list string")


def etim_class_feature_df(spark: SparkSession) -> DataFrame:
    return local_rows(
        spark, ETIM_CLASS_FEATURES, "class_code string, feature_code string, is_mandatory boolean, "
                             "sort_order int")


UOM_DDL = ("source_unit string, target_unit string, conversion_factor decimal(38,18), "
           "conversion_offset decimal(38,18), unit_type string, is_active boolean")


def uom_df(spark: SparkSession, with_builtin: bool = True) -> DataFrame:
    """Unit table: seeded pairs, plus built-in pairs the seeds lack."""
    from decimal import Decimal
    rows = {(s, t): (s, t, Decimal(f), Decimal(o), k, True) for s, t, f, o, k in UOM_SEEDS}
    if with_builtin:
        for s, t, f, o, k in UOM_BUILTIN:
            rows.setdefault((s, t), (s, t, Decimal(f), Decimal(o), k, True))
    return local_rows(spark, list(rows.values()), UOM_DDL)
