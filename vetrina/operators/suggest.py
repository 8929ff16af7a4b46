"""Suggestions.

* P12 maps source column names to product fields / ETIM features with
  ordered substring rules (first hit wins);
* P13 pairs a value column with its unit column in the same file;
* P14 adapts a predefined template to the columns a file actually has;
* V11 proposes validation rules from the values of each column;
* V12 proposes rules from ETIM reference data.

Column-name tables are small per file but there may be very many files,
so the name rules are a broadcast rule table joined with a ``contains``
condition (a broadcast nested-loop join against a fixed, tiny rule side)
and the first hit per column is chosen with ``min_by``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetrina.functions.normalize import is_blank, python_float
from vetrina.operators.profile import to_long, top_k_per_group

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference: (priority, keyword, target
# kind, target, confidence).  Order is the order the reference tests them.
# ``artikel`` is our addition for German files; it is left
# out in compat mode.
# ---------------------------------------------------------------------------
NAME_RULES = [
    (0, "sku", "field", "sku", 0.9), (0, "article", "field", "sku", 0.9),
    (0, "item", "field", "sku", 0.9), (0, "product_id", "field", "sku", 0.9),
    (1, "gtin", "field", "gtin", 0.85), (1, "ean", "field", "gtin", 0.85),
    (1, "barcode", "field", "gtin", 0.85),
    (2, "name", "field", "product_name", 0.8), (2, "title", "field", "product_name", 0.8),
    (2, "description", "field", "product_name", 0.8), (2, "bezeichnung", "field", "product_name", 0.8),
    (3, "brand", "field", "brand", 0.75), (3, "marke", "field", "brand", 0.75),
    (3, "hersteller", "field", "brand", 0.75), (3, "manufacturer", "field", "brand", 0.75),
    (4, "length", "feature", "EF001001", 0.8), (4, "länge", "feature", "EF001001", 0.8),
    (4, "laenge", "feature", "EF001001", 0.8),
    (5, "diameter", "feature", "EF001002", 0.8), (5, "durchmesser", "feature", "EF001002", 0.8),
    (5, "width", "feature", "EF001002", 0.8), (5, "breite", "feature", "EF001002", 0.8),
    (6, "material", "feature", "EF001003", 0.7), (6, "werkstoff", "feature", "EF001003", 0.7),
]
EXTRA_NAME_RULES = [(0, "artikel", "field", "sku", 0.9)]
UNIT_WORDS = ["unit", "einheit", "uom"]
VALUE_SUFFIXES = ["_value", "_val", "value", "val"]
SUGGEST_REQUIRED_CONF = 0.9
SUGGEST_RANGE_CONF = 0.8
SUGGEST_GTIN_CONF = 0.85
SUGGEST_EMAIL_CONF = 0.8
SUGGEST_DOMAIN_CONF = 0.7
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
GTIN_SUGGEST_PATTERN = r"^\d{8}|\d{12}|\d{13}|\d{14}$"
ETIM_NUMERIC_PATTERN = r"^\d+(\.\d+)?$"


def name_rules_df(spark, compat: bool = False) -> DataFrame:
    """P12 name rules (priority, keyword, kind, target, confidence) as a DataFrame."""
    rules = NAME_RULES + ([] if compat else EXTRA_NAME_RULES)
    return spark.createDataFrame(rules, "priority int, keyword string, kind string, target string, "
                                        "confidence double")


def suggest_targets(columns: DataFrame, rules: DataFrame, compat: bool = False) -> DataFrame:
    """``columns(file_id, ordinal, column_name)`` -> first matching rule.

    A rule matches when its keyword occurs in the lower-cased, stripped
    name; the lowest priority wins (ties: keyword order is irrelevant, all
    keywords of a priority share the target).  By default unit columns
    (``Length_Unit``) are not offered to the feature rules, so a value and
    its unit no longer both map to one feature (SURVEY 3.5 #15)."""
    name = F.lower(F.trim(F.col("column_name")))
    is_unit = F.exists(F.array(*[F.lit(w) for w in UNIT_WORDS]), lambda w: name.contains(w))
    c = columns.withColumn("__name", name).withColumn("__is_unit", is_unit)
    cond = F.col("__name").contains(F.col("keyword"))
    if not compat:
        cond = cond & ~(F.col("__is_unit") & (F.col("kind") == "feature"))
    hits = c.join(F.broadcast(rules), cond, "inner")
    best = hits.groupBy("file_id", "ordinal", "column_name").agg(
        F.min_by(F.struct("kind", "target", "confidence"), F.col("priority")).alias("s"))
    return best.select("file_id", "ordinal", "column_name", "s.kind", "s.target", "s.confidence")


def _base_name(col_lower):
    out = col_lower
    for suf in VALUE_SUFFIXES:
        out = F.replace(out, F.lit(suf), F.lit(""))
    return out


def pair_unit_columns(columns: DataFrame) -> DataFrame:
    """For every column, the first other column (by ordinal) whose
    name has a unit word and contains the column's base name or any ``_``
    part of it.  A self-join within each file."""
    a = columns.select("file_id", F.col("ordinal").alias("v_ord"), F.col("column_name").alias("value_column"))
    b = columns.select("file_id", F.col("ordinal").alias("u_ord"), F.col("column_name").alias("unit_column"))
    vl = F.lower(F.col("value_column"))
    ul = F.lower(F.col("unit_column"))
    base = _base_name(vl)
    related = ul.contains(base) | F.exists(F.split(base, "_"), lambda p: ul.contains(p))
    has_unit = F.exists(F.array(*[F.lit(w) for w in UNIT_WORDS]), lambda w: ul.contains(w))
    j = a.join(b, "file_id").filter((F.col("value_column") != F.col("unit_column")) & has_unit & related)
    return j.groupBy("file_id", "v_ord", "value_column").agg(
        F.min_by("unit_column", "u_ord").alias("unit_column"))


def adapt_template(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Match each expected column of a predefined template to every
    file's columns: equal names score 1.0, containment either way 0.8
    (case-insensitive); the best score wins, then the first column.

    ``expected`` (ordinal, column_name) is the template's handful of names:
    it is broadcast and joined with the containment condition, so each
    file's columns are compared with it without pairing files."""
    e = expected.select(F.col("ordinal").alias("e_ord"), F.col("column_name").alias("expected"))
    a = actual.select("file_id", F.col("ordinal").alias("a_ord"), F.col("column_name").alias("actual"))
    el, al = F.lower(F.col("expected")), F.lower(F.col("actual"))
    cond = (el == al) | al.contains(el) | el.contains(al)
    j = a.join(F.broadcast(e), cond).withColumn("score", F.when(el == al, 1.0).otherwise(0.8))
    best = j.groupBy("file_id", "e_ord", "expected").agg(
        F.min_by(F.struct("actual", "score"), F.struct(-F.col("score"), F.col("a_ord"))).alias("m"))
    return best.select("file_id", "e_ord", "expected", "m.actual", "m.score")


def suggest_rules(df: DataFrame, columns: list[str] | None = None, compat: bool = False) -> DataFrame:
    """Rule suggestions per column from all of its values.

    Rules: required when every value is non-blank (0.9); range when more
    than 80 % of values parse as numbers, bounds widened by 20 % away from
    zero (compat: min*0.8, max*1.2) (0.8, WARN); GTIN format when more
    than 70 % of the non-empty values are 8/12/13/14 digits (0.85); email
    when more than 70 % contain '@' and '.' (0.8, WARN); domain when at
    most 10 distinct non-empty values and fewer than half the count (0.7,
    WARN).  The domain value list is taken from a top-11 of value counts,
    so no column's values are ever collected whole."""
    long = to_long(df, columns)
    v = F.col("value")
    nonempty = v.isNotNull() & (v != "")
    num = python_float(v)
    digits = v.rlike(r"^[0-9]+$") & F.length(v).isin(8, 12, 13, 14)
    st = long.groupBy("column").agg(
        F.count("*").alias("n"), F.count_if(~is_blank(v)).alias("n_nonblank"),
        F.count_if(num.isNotNull()).alias("n_numeric"), F.min(num).alias("vmin"), F.max(num).alias("vmax"),
        F.count_if(nonempty).alias("n_str"), F.count_if(nonempty & digits).alias("n_gtin"),
        F.count_if(nonempty & v.contains("@") & v.contains(".")).alias("n_email"))
    vc = long.filter(nonempty).groupBy("column", "value").agg(F.count("*").alias("cnt"))
    nd = vc.groupBy("column").agg(F.count("*").alias("n_distinct"))
    top = (top_k_per_group(vc, ["column"], [F.col("cnt").desc(), F.col("value")], 11)
           .groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("vals")))
    s = st.join(nd, "column", "left").join(top, "column", "left").fillna(0, ["n_distinct"])
    lo = F.col("vmin") * 0.8 if compat else F.when(F.col("vmin") >= 0, F.col("vmin") * 0.8).otherwise(F.col("vmin") * 1.2)
    hi = F.col("vmax") * 1.2 if compat else F.when(F.col("vmax") >= 0, F.col("vmax") * 1.2).otherwise(F.col("vmax") * 0.8)
    sug = lambda cond, rt, sev, conf, rmin=None, rmax=None, vals=None, pat=None: F.when(cond, F.struct(
        F.lit(rt).alias("rule_type"), F.lit(sev).alias("severity"), F.lit(conf).alias("confidence"),
        (rmin if rmin is not None else F.lit(None).cast("double")).alias("range_min"),
        (rmax if rmax is not None else F.lit(None).cast("double")).alias("range_max"),
        (vals if vals is not None else F.lit(None).cast("array<string>")).alias("domain_values"),
        F.lit(pat).cast("string").alias("pattern")))
    n, ns = F.col("n"), F.col("n_str")
    arr = F.array(
        sug((n > 0) & (F.col("n_nonblank") == n), "required", "ERROR", SUGGEST_REQUIRED_CONF),
        sug((n > 0) & (F.col("n_numeric") > n * 0.8), "range", "WARN", SUGGEST_RANGE_CONF, lo, hi),
        sug((ns > 0) & (F.col("n_gtin") > ns * 0.7), "gtin_format", "ERROR", SUGGEST_GTIN_CONF,
            pat=GTIN_SUGGEST_PATTERN),
        sug((ns > 0) & (F.col("n_email") > ns * 0.7), "email_format", "WARN", SUGGEST_EMAIL_CONF,
            pat=EMAIL_PATTERN),
        sug((ns > 0) & (F.col("n_distinct") <= 10) & (F.col("n_distinct") < ns * 0.5), "domain", "WARN",
            SUGGEST_DOMAIN_CONF, vals=F.col("vals")),
    )
    return (s.select("column", F.explode_outer(F.filter(arr, lambda x: x.isNotNull())).alias("r"))
            .filter(F.col("r").isNotNull()).select("column", "r.*"))


def suggest_rules_from_reference(class_features: DataFrame, features: DataFrame) -> DataFrame:
    """Mandatory class-feature -> required (1.0, ERROR); numeric
    feature -> numeric format (0.95, ERROR).  Join of two dimensions."""
    j = class_features.join(features, "feature_code")
    arr = F.filter(F.array(
        F.when(F.col("is_mandatory"), F.struct(F.lit("etim_required").alias("suggestion"),
                                                F.lit("required").alias("rule_type"),
                                                F.lit(None).cast("string").alias("pattern"),
                                                F.lit(1.0).alias("confidence"))),
        F.when(F.col("data_type") == "N", F.struct(F.lit("etim_numeric").alias("suggestion"),
                                                    F.lit("format").alias("rule_type"),
                                                    F.lit(ETIM_NUMERIC_PATTERN).alias("pattern"),
                                                    F.lit(0.95).alias("confidence")))),
        lambda x: x.isNotNull())
    return (j.select("class_code", "feature_code", F.explode(arr).alias("s"))
            .select("class_code", "feature_code", "s.*", F.lit("ERROR").alias("severity")))
