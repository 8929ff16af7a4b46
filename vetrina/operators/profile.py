"""Column profiling.

A table of any width is unpivoted to a long ``(column, value)`` form and
aggregated once to value counts -- the only shuffle of the cell data,
partially aggregated before it.  Everything else is computed from the
value counts: parses and regex tests run once per distinct value, counts
are weighted sums, the exact distinct count is a row count and the top-5
is an exact two-stage top-k.  Spark reuses the value-count exchange for
all three consumers.

The reference profiles a 1000-row sample; here every row counts (true
counts, SURVEY 3.5 #8), so a type guess looks at all clean values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vetrina.functions.normalize import is_date_like, py_strip, python_float

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference.
# ---------------------------------------------------------------------------
PATTERNS = [
    ("product_code", r"^[A-Z]{2,3}\d{3,}$"),
    ("barcode_ean", r"^\d{8,14}$"),
    ("email", r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"),
    ("phone", r"^\+?[\d\s\-\(\)]{7,}$"),
    ("date_iso", r"^\d{4}-\d{2}-\d{2}$"),
    ("currency", r"^\d+\.\d{2}$"),
]
BOOLEAN_WORDS = ["true", "false", "yes", "no", "1", "0", "y", "n"]
SUSPICIOUS_NAMES = [r"^Unnamed:", r"^Column\d+$", r"^\d+$"]
TYPE_RATIO = 0.8
PATTERN_REFINE_RATIO = 0.8
WIDE_TABLE_COLUMNS = 100
SPARSE_RATIO = 0.7
LOW_COMPLETENESS = 0.5
TOP_K = 5


def to_long(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Unpivot to ``(column, ordinal, value)`` with every value as text.

    Columns are addressed by position, so two of one name stay apart."""
    if columns is None:
        columns = df.columns
    else:
        df = df.select(*[F.col(f"`{c}`") for c in columns])
    at = df.toDF(*[f"c{i}" for i in range(len(columns))])
    pairs = [F.struct(F.lit(c).alias("column"), F.lit(i).alias("ordinal"),
                      F.col(f"c{i}").cast("string").alias("value"))
             for i, c in enumerate(columns)]
    return at.select(F.explode(F.array(*pairs)).alias("kv")).select("kv.*")


def _numeric_value(v):
    """Numeric value as the profiler parses it: commas dropped (3.5 #22)."""
    return python_float(F.regexp_replace(v, ",", ""))


def _units(v, num):
    """The number in units of 1e-8, where that is exact: its sums do not
    depend on the order of the rows."""
    d = py_strip(F.regexp_replace(v, ",", "")).try_cast("decimal(20,8)")
    return F.when(d.cast("double") == num, (d * F.lit(100_000_000).cast("decimal(9,0)")).cast("decimal(20,0)"))


def _exact_mean():
    """Sum of units by count, rounded half up at six places in whole numbers;
    null unless every number of the column has exact units."""
    places = F.expr("(abs(__units) * 2 + numeric_count * 100) div (numeric_count * 200)")
    signed = F.when(F.col("__units") < 0, -places).otherwise(places)
    return F.when((F.col("numeric_count") > 0) & (F.col("__exact") == F.col("numeric_count")),
                  signed.cast("double") / F.lit(1e6))


def value_counts(long: DataFrame) -> DataFrame:
    """(column, value) -> count, null values included.  This is the only
    shuffle of the cell data; partial aggregation folds repeated values
    before it."""
    return long.groupBy("column", "ordinal", "value").agg(F.count("*").alias("cnt"))


def _value_flags(vc: DataFrame) -> DataFrame:
    """Per distinct value: the parses and pattern tests, evaluated once per
    distinct value instead of once per cell."""
    v = F.col("value")
    clean = v.isNotNull() & (v != "")
    s = py_strip(v)
    return vc.select(
        "column", "ordinal", "value", "cnt", clean.alias("clean"),
        F.when(clean, _numeric_value(v)).alias("num"),
        F.when(clean, F.length(v)).alias("len"),
        (clean & is_date_like(v)).alias("is_date"),
        (clean & F.lower(s).isin(*BOOLEAN_WORDS)).alias("is_bool"),
        *[(clean & s.rlike(pat)).alias(f"is_{name}") for name, pat in PATTERNS]).withColumn(
        "units", F.when(F.col("num").isNotNull(), _units(v, F.col("num"))))


def column_stats(vc: DataFrame) -> DataFrame:
    """A01, A03, A04, A05, A06 per column from the value counts.

    Counts are weighted sums; mean and average length are weighted means
    (``mean_6``: exact at six places where all numbers are plain decimals,
    so it does not depend on the order of summation); the sample standard deviation is a second pass over the distinct
    numeric values against the column mean (numerically stable), joined
    with a one-row-per-column table."""
    d = _value_flags(vc)
    w = lambda cond: F.sum(F.when(cond, F.col("cnt")).otherwise(F.lit(0))).cast("bigint")
    num, ln = F.col("num"), F.col("len")
    aggs = [
        F.sum("cnt").cast("bigint").alias("total_count"),
        w(F.col("value").isNull()).alias("null_count"),
        w(F.col("value") == "").alias("empty_count"),
        w(F.col("clean")).alias("clean_count"),
        F.count_if(F.col("value").isNotNull()).cast("bigint").alias("unique_count"),
        w(num.isNotNull()).alias("numeric_count"),
        w(F.col("is_date")).alias("date_count"),
        w(F.col("is_bool")).alias("boolean_count"),
        F.min(num).alias("min_value"), F.max(num).alias("max_value"),
        F.sum(num * F.col("cnt")).alias("__sum"),
        F.sum(F.col("units") * F.col("cnt").cast("decimal(18,0)")).cast("decimal(38,0)").alias("__units"),
        w(F.col("units").isNotNull()).alias("__exact"),
        F.min(ln).alias("min_length"), F.max(ln).alias("max_length"),
        F.sum(ln * F.col("cnt")).alias("__len_sum"),
    ]
    for name, _ in PATTERNS:
        aggs.append(w(F.col(f"is_{name}")).alias(f"pat_{name}"))
    st = d.groupBy("ordinal", "column").agg(*aggs)
    st = st.withColumn("mean_value", F.when(F.col("numeric_count") > 0, F.col("__sum") / F.col("numeric_count"))) \
           .withColumn("avg_length", F.when(F.col("clean_count") > 0, F.col("__len_sum") / F.col("clean_count")))
    st = st.withColumn("mean_6", F.coalesce(_exact_mean(), "mean_value"))
    means = st.select("ordinal", "mean_value")
    var = (d.filter(num.isNotNull()).join(F.broadcast(means), "ordinal")
           .groupBy("ordinal").agg(F.sum(F.col("cnt") * F.pow(num - F.col("mean_value"), 2)).alias("__ss")))
    st = st.join(var, "ordinal", "left").withColumn(
        "std_value", F.when(F.col("numeric_count") > 1, F.sqrt(F.col("__ss") / (F.col("numeric_count") - 1))))
    return _with_guess(st.drop("__sum", "__units", "__exact", "__len_sum", "__ss"))


def top_k_per_group(df: DataFrame, group: list[str], order: list, k: int,
                    buckets: int = 256, bucket_key: str = "value") -> DataFrame:
    """Exact top-k per group without putting a whole group in one task.

    Stage 1 ranks within (group, hash bucket of the key) and keeps k rows
    per bucket; stage 2 ranks the at most ``buckets * k`` survivors of each
    group.  Exact because ``order`` is a total order and every row of the
    global top-k is in the top-k of its own bucket."""
    b = F.pmod(F.xxhash64(F.col(bucket_key)), F.lit(buckets))
    w1 = Window.partitionBy(*group, "__b").orderBy(*order)
    local = (df.withColumn("__b", b).withColumn("__r", F.row_number().over(w1))
             .filter(F.col("__r") <= k).drop("__r", "__b"))
    w2 = Window.partitionBy(*group).orderBy(*order)
    return local.withColumn("rk", F.row_number().over(w2)).filter(F.col("rk") <= k)


def top_values(vc: DataFrame, k: int = TOP_K) -> DataFrame:
    """A02 top-k values per column (ties: value ascending)."""
    ranked = top_k_per_group(vc.filter(F.col("value").isNotNull()), ["ordinal"],
                             [F.col("cnt").desc(), F.col("value")], k)
    return ranked.groupBy("ordinal").agg(
        F.array_sort(F.collect_list(F.struct("rk", "value", "cnt"))).alias("top_values"))


def column_stats_sketch(long: DataFrame, k: int = TOP_K) -> DataFrame:
    """A01-A06 without shuffling cells: every cell's flags are aggregated per
    column (one partial row per column per task reaches the shuffle); the
    distinct count is a HyperLogLog estimate and the top values come from
    ``approx_top_k``.  Counts, ratios and numeric statistics stay exact."""
    v = F.col("value")
    clean = v.isNotNull() & (v != "")
    s = py_strip(v)
    cells = long.select(
        "column", "ordinal", v, clean.alias("clean"), F.when(clean, _numeric_value(v)).alias("num"),
        F.when(clean, F.length(v)).alias("len"), (clean & is_date_like(v)).alias("is_date"),
        (clean & F.lower(s).isin(*BOOLEAN_WORDS)).alias("is_bool"),
        *[(clean & s.rlike(pat)).alias(f"is_{name}") for name, pat in PATTERNS])
    num, ln = F.col("num"), F.col("len")
    aggs = [F.count("*").alias("total_count"),
            F.count_if(v.isNull()).alias("null_count"), F.count_if(v == "").alias("empty_count"),
            F.count_if("clean").alias("clean_count"),
            F.approx_count_distinct(v, rsd=0.01).cast("bigint").alias("unique_count"),
            F.count_if(num.isNotNull()).alias("numeric_count"), F.count_if("is_date").alias("date_count"),
            F.count_if("is_bool").alias("boolean_count"),
            F.min(num).alias("min_value"), F.max(num).alias("max_value"), F.avg(num).alias("mean_value"), F.avg(num).alias("mean_6"),
            F.stddev_samp(num).alias("std_value"), F.min(ln).alias("min_length"), F.max(ln).alias("max_length"),
            F.avg(ln).alias("avg_length"), F.expr(f"approx_top_k(value, {k})").alias("__top")]
    aggs += [F.count_if(f"is_{name}").alias(f"pat_{name}") for name, _ in PATTERNS]
    st = cells.groupBy("ordinal", "column").agg(*aggs)
    st = st.withColumn("top_values", F.transform(
        "__top", lambda x, i: F.struct((i + 1).alias("rk"), x["item"].alias("value"), x["count"].alias("cnt"))))
    return _with_guess(st.drop("__top"))


def _with_guess(st: DataFrame) -> DataFrame:
    """Completeness, type guess and ranked patterns from the counts."""
    n = F.col("clean_count").cast("double")
    guess = (F.when(F.col("clean_count") == 0, F.lit("string"))
              .when(F.col("numeric_count") / n > TYPE_RATIO, "numeric")
              .when(F.col("date_count") / n > TYPE_RATIO, "date")
              .when(F.col("boolean_count") / n > TYPE_RATIO, "boolean")
              .otherwise("string"))
    patterns = F.filter(F.array(*[
        F.struct(F.lit(i).alias("rank"), F.lit(name).alias("pattern"),
                 F.col(f"pat_{name}").alias("matches"),
                 (F.col(f"pat_{name}") / n).alias("confidence"))
        for i, (name, _) in enumerate(PATTERNS)]), lambda p: p["matches"] > 0)
    patterns = F.array_sort(patterns, lambda a, b: F.when(a["confidence"] > b["confidence"], -1)
                            .when(a["confidence"] < b["confidence"], 1)
                            .otherwise(a["rank"] - b["rank"]))
    return st.select(
        "*",
        (1.0 - (F.col("null_count") + F.col("empty_count")) / F.col("total_count")).alias("completeness"),
        guess.alias("data_type_guess"), patterns.alias("patterns"))


def profile_columns(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Full column profile: one row per column.

    ``exact`` (default) shuffles value counts for exact distinct counts and
    top values; ``exact=False`` is the sketch mode for very large tables,
    whose only shuffle is one partial row per column per task."""
    long = to_long(df, columns)
    if exact:
        vc = value_counts(long)
        p = column_stats(vc).join(top_values(vc), "ordinal", "left")
    else:
        p = column_stats_sketch(long)
    numeric = F.col("data_type_guess") == "numeric"
    string = F.col("data_type_guess") == "string"
    top = F.get(F.col("patterns"), 0)
    refined = (F.when(top.isNotNull() & (top["confidence"] > PATTERN_REFINE_RATIO),
                      F.when(top["pattern"] == "barcode_ean", "string")
                       .when(top["pattern"] == "date_iso", "date")
                       .when(top["pattern"] == "currency", "decimal")
                       .otherwise(F.col("data_type_guess")))
                .otherwise(F.col("data_type_guess")))
    return p.select(
        "column", "ordinal", "total_count", "null_count", "empty_count", "unique_count",
        "completeness", "data_type_guess", refined.alias("suggested_type"), "patterns", "top_values",
        *[F.when(numeric, F.col(c)).alias(c) for c in ("min_value", "max_value", "mean_value", "mean_6",
                                                        "std_value")],
        F.when(string, F.col("min_length")).alias("min_length"),
        F.when(string, F.col("max_length")).alias("max_length"),
        F.when(string, F.col("avg_length")).alias("avg_length"))


def profile_score(profile: DataFrame) -> DataFrame:
    """Mean of cell completeness, mean column completeness and mean
    uniqueness (min(1, distinct/total)); an empty table scores 0."""
    return profile.agg(
        F.sum("total_count").alias("cells"),
        F.sum(F.col("null_count") + F.col("empty_count")).alias("missing_cells"),
        F.avg("completeness").alias("column_completeness"),
        F.avg(F.least(F.lit(1.0), F.col("unique_count") / F.col("total_count"))).alias("uniqueness"),
        F.count("*").alias("n_columns"),
        F.max("total_count").alias("n_rows"),
    ).select(
        "n_rows", "n_columns",
        F.when(F.col("n_rows") > 0,
               ((1.0 - F.col("missing_cells") / F.col("cells")) + F.col("column_completeness")
                + F.col("uniqueness")) / 3.0).otherwise(F.lit(0.0)).alias("quality_score"))


def structural_issues(profile: DataFrame) -> DataFrame:
    """Empty or sparse columns, duplicate / suspicious names, a very
    wide table, very sparse data.  One row per finding."""
    per_col = profile.select(
        "column", "ordinal",
        F.filter(F.array(
            F.when(F.col("completeness") == 0, F.struct(F.lit("empty_column").alias("issue"),
                                                        F.lit(None).cast("double").alias("measure"))),
            F.when((F.col("completeness") > 0) & (F.col("completeness") < LOW_COMPLETENESS),
                   F.struct(F.lit("low_completeness").alias("issue"), F.col("completeness").alias("measure"))),
            F.when(F.col("column").rlike("|".join(f"(?:{p})" for p in SUSPICIOUS_NAMES)),
                   F.struct(F.lit("suspicious_name").alias("issue"), F.lit(None).cast("double").alias("measure"))),
        ), lambda x: x.isNotNull()).alias("found"))
    col_issues = per_col.select("column", F.explode("found").alias("f")).select(
        "column", "f.issue", "f.measure")
    table_level = profile.agg(
        F.count("*").alias("n_columns"),
        (F.sum("null_count") / F.sum("total_count")).alias("sparsity"),
        (F.count("*") - F.count_distinct("column")).alias("dup_names"))
    t_issues = table_level.select(F.explode(F.filter(F.array(
        F.when(F.col("n_columns") > WIDE_TABLE_COLUMNS,
               F.struct(F.lit("wide_table").alias("issue"), F.col("n_columns").cast("double").alias("measure"))),
        F.when(F.col("sparsity") > SPARSE_RATIO,
               F.struct(F.lit("sparse_data").alias("issue"), F.col("sparsity").alias("measure"))),
        F.when(F.col("dup_names") > 0,
               F.struct(F.lit("duplicate_names").alias("issue"), F.col("dup_names").cast("double").alias("measure"))),
    ), lambda x: x.isNotNull())).alias("f")).select(F.lit(None).cast("string").alias("column"), "f.issue",
                                                      "f.measure")
    return col_issues.unionByName(t_issues)
