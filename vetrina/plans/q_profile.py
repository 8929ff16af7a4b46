"""Registered queries: column profiling (A01-A09) over driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetrina.functions.normalize import NUMBER_RE
from vetrina.operators import profile as P
from vetrina.plans.fixtures import raw_product, raw_product_sql, RAW_PRODUCT_COLUMNS
from vetrina.plans.registry import register, round_doubles
from vetrina.plans.sqlfrag import r6, strip
from vetrina.sources.tables import table

CUSTOMER_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
PART_COLS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
EVENT_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props"]
DOC_COLS = ["doc_id", "lang", "source", "n_chars", "quality", "toxic"]


def _docs_labels(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return d.join(lab, "doc_id", "left")


def long_sql(source: str, cols: list[str], prefix: str = "") -> str:
    parts = [f"SELECT '{c}' AS \"column\", {i} AS ordinal, CAST(\"{c}\" AS VARCHAR) AS value FROM {source}"
             for i, c in enumerate(cols)]
    return f"{prefix}long AS (\n  " + "\n  UNION ALL ".join(parts) + ")"


def _num(v: str) -> str:
    s = strip(f"replace({v}, ',', '')")
    return f"(CASE WHEN regexp_full_match({s}, '{NUMBER_RE[1:-1]}') THEN TRY_CAST({s} AS DOUBLE) END)"


def _units(v: str) -> str:
    """Whole units of 1e-8 where the number is exact in them, else null."""
    d = f"TRY_CAST({strip(f"replace({v}, ',', '')")} AS DECIMAL(20, 8))"
    return f"(CASE WHEN CAST({d} AS DOUBLE) = {_num(v)} THEN CAST({d} * 100000000 AS HUGEINT) END)"


#: Mean rounded half up at six places in whole numbers where every number is a
#: plain decimal; sums of doubles depend on the order of the rows.
MEAN_6 = ("CASE WHEN numeric_count > 0 AND exact_count = numeric_count THEN (CASE WHEN units < 0 THEN -1 ELSE 1 END) * "
          "CAST((abs(units) * 2 + CAST(numeric_count AS HUGEINT) * 100) // (CAST(numeric_count AS HUGEINT) * 200) AS DOUBLE) / 1e6 "
          "ELSE mean_value END")

DATE_RE = r"^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})"


def stats_sql(long_cte: str) -> str:
    clean = "(value IS NOT NULL AND value <> '')"
    bools = ", ".join(f"'{w}'" for w in P.BOOLEAN_WORDS)
    return f"""WITH {long_cte},
st AS (
  SELECT "column", count(*) AS total_count,
    count(*) FILTER (WHERE value IS NULL) AS null_count,
    count(*) FILTER (WHERE value = '') AS empty_count,
    count(*) FILTER (WHERE {clean}) AS clean_count,
    count(*) FILTER (WHERE {clean} AND {_num('value')} IS NOT NULL) AS numeric_count,
    count(*) FILTER (WHERE {clean} AND regexp_matches({strip('value')}, '{DATE_RE}')) AS date_count,
    count(*) FILTER (WHERE {clean} AND lower({strip('value')}) IN ({bools})) AS boolean_count,
    min(CASE WHEN {clean} THEN {_num('value')} END) AS min_value,
    max(CASE WHEN {clean} THEN {_num('value')} END) AS max_value,
    avg(CASE WHEN {clean} THEN {_num('value')} END) AS mean_value,
    sum(CASE WHEN {clean} THEN {_units('value')} END) AS units,
    count(CASE WHEN {clean} THEN {_units('value')} END) AS exact_count,
    stddev_samp(CASE WHEN {clean} THEN {_num('value')} END) AS std_value,
    min(CASE WHEN {clean} THEN length(value) END) AS min_length,
    max(CASE WHEN {clean} THEN length(value) END) AS max_length,
    avg(CASE WHEN {clean} THEN length(value) END) AS avg_length
  FROM long GROUP BY "column"),
g AS (
  SELECT *, CASE WHEN clean_count = 0 THEN 'string'
    WHEN numeric_count / CAST(clean_count AS DOUBLE) > 0.8 THEN 'numeric'
    WHEN date_count / CAST(clean_count AS DOUBLE) > 0.8 THEN 'date'
    WHEN boolean_count / CAST(clean_count AS DOUBLE) > 0.8 THEN 'boolean'
    ELSE 'string' END AS data_type_guess
  FROM st)"""


@register("a01_profile_counts", f"""{stats_sql(long_sql('customer', CUSTOMER_COLS))},
vc AS (SELECT "column", count(DISTINCT value) AS unique_count FROM long GROUP BY "column")
SELECT g."column", total_count, null_count, empty_count, vc.unique_count,
       {r6('1.0 - (null_count + empty_count) / CAST(total_count AS DOUBLE)')} AS completeness
FROM g JOIN vc ON g."column" = vc."column" """)
def q_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total / null / empty / distinct counts and completeness."""
    p = P.profile_columns(table(spark, sf_dir, "customer"), CUSTOMER_COLS)
    return round_doubles(p.select("column", "total_count", "null_count", "empty_count",
                                  "unique_count", "completeness"))


@register("a02_top_values", f"""WITH {long_sql('part', PART_COLS)},
vc AS (SELECT "column", value, count(*) AS cnt FROM long WHERE value IS NOT NULL GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY cnt DESC, value) AS rk FROM vc)
SELECT "column", CAST(rk AS INTEGER) AS rk, value, cnt FROM rk WHERE rk <= 5""")
def q_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most frequent values per column (ties: value asc)."""
    p = P.profile_columns(table(spark, sf_dir, "part"), PART_COLS)
    return (p.select("column", F.explode("top_values").alias("t"))
            .select("column", F.col("t.rk").cast("int").alias("rk"), "t.value", "t.cnt"))


def _stats_select(cols_sql_src: str, cols: list[str]) -> str:
    return f"""{stats_sql(long_sql(cols_sql_src, cols))}
SELECT "column", data_type_guess,
  {r6("CASE WHEN data_type_guess = 'numeric' THEN min_value END")} AS min_value,
  {r6("CASE WHEN data_type_guess = 'numeric' THEN max_value END")} AS max_value,
  {r6(f"CASE WHEN data_type_guess = 'numeric' THEN {MEAN_6} END")} AS mean_value,
  {r6("CASE WHEN data_type_guess = 'numeric' THEN std_value END")} AS std_value,
  CASE WHEN data_type_guess = 'string' THEN min_length END AS min_length,
  CASE WHEN data_type_guess = 'string' THEN max_length END AS max_length,
  {r6("CASE WHEN data_type_guess = 'string' THEN avg_length END")} AS avg_length
FROM g"""


@register("a03_a05_column_stats", _stats_select("events", EVENT_COLS))
def q_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type guess, numeric stats, string-length stats."""
    p = P.profile_columns(table(spark, sf_dir, "events"), EVENT_COLS)
    return round_doubles(p.select("column", "data_type_guess", "min_value", "max_value", F.col("mean_6").alias("mean_value"),
                                  "std_value", F.col("min_length").cast("bigint").alias("min_length"),
                                  F.col("max_length").cast("bigint").alias("max_length"), "avg_length"))


def _pattern_ctes() -> str:
    """pc: per-column pattern match counts; pl: one row per (column, pattern)."""
    clean = "(value IS NOT NULL AND value <> '')"
    cnts = ",\n    ".join(
        f"count(*) FILTER (WHERE {clean} AND regexp_matches({strip('value')}, '{pat}')) AS \"pat_{name}\""
        for name, pat in P.PATTERNS)
    unions = "\n  UNION ALL ".join(
        f"SELECT \"column\", {i} AS rnk, '{name}' AS pattern, \"pat_{name}\" AS matches, clean_count FROM pc"
        for i, (name, _) in enumerate(P.PATTERNS))
    return f"""pc AS (SELECT "column", count(*) FILTER (WHERE {clean}) AS clean_count,
    {cnts}
  FROM long GROUP BY "column"),
pl AS ({unions}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY matches DESC, rnk) AS position
           FROM pl WHERE matches > 0)"""


RP_LONG = long_sql('raw_product', RAW_PRODUCT_COLUMNS, prefix=raw_product_sql() + ', ')


@register("a06_patterns", f"""WITH {RP_LONG},
{_pattern_ctes()}
SELECT "column", pattern, matches, {r6('matches / CAST(clean_count AS DOUBLE)')} AS confidence,
       CAST(position AS INTEGER) AS position
FROM ranked""")
def q_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six value patterns with match counts and confidence, ranked."""
    p = P.profile_columns(raw_product(spark, sf_dir), RAW_PRODUCT_COLUMNS)
    return round_doubles(
        p.select("column", F.posexplode("patterns").alias("pos", "p"))
         .select("column", "p.pattern", "p.matches", "p.confidence",
                 (F.col("pos") + 1).cast("int").alias("position")))


@register("a07_type_refinement", f"""{stats_sql(RP_LONG)},
{_pattern_ctes()}
SELECT g."column", g.data_type_guess,
  CASE WHEN t.matches / CAST(t.clean_count AS DOUBLE) > 0.8 THEN
    CASE t.pattern WHEN 'barcode_ean' THEN 'string' WHEN 'date_iso' THEN 'date'
                   WHEN 'currency' THEN 'decimal' ELSE g.data_type_guess END
  ELSE g.data_type_guess END AS suggested_type
FROM g LEFT JOIN ranked t ON g."column" = t."column" AND t.position = 1""")
def q_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dominant pattern (>80 %) refines the guessed type."""
    p = P.profile_columns(raw_product(spark, sf_dir), RAW_PRODUCT_COLUMNS)
    return p.select("column", "data_type_guess", "suggested_type")


@register("a08_profile_score", f"""{stats_sql(RP_LONG)},
vc AS (SELECT "column", count(DISTINCT value) AS unique_count FROM long GROUP BY "column"),
pc AS (SELECT g.*, vc.unique_count FROM g JOIN vc USING ("column"))
SELECT max(total_count) AS n_rows, count(*) AS n_columns,
  {r6('''((1.0 - sum(null_count + empty_count) / CAST(sum(total_count) AS DOUBLE))
     + avg(1.0 - (null_count + empty_count) / CAST(total_count AS DOUBLE))
     + avg(least(1.0, unique_count / CAST(total_count AS DOUBLE)))) / 3.0''')} AS quality_score
FROM pc""")
def q_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile quality score of a whole file."""
    p = P.profile_columns(raw_product(spark, sf_dir), RAW_PRODUCT_COLUMNS)
    return round_doubles(P.profile_score(p))


@register("a09_structural_issues", f"""WITH docs AS (
  SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
{long_sql('docs', DOC_COLS)},
st AS (SELECT "column", 1.0 - count(*) FILTER (WHERE value IS NULL OR value = '') / CAST(count(*) AS DOUBLE) AS completeness
       FROM long GROUP BY "column")
SELECT "column", CASE WHEN completeness = 0 THEN 'empty_column' ELSE 'low_completeness' END AS issue,
       {r6("CASE WHEN completeness = 0 THEN NULL ELSE completeness END")} AS measure
FROM st WHERE completeness < 0.5""")
def q_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural findings (documents with their partial labels)."""
    p = P.profile_columns(_docs_labels(spark, sf_dir), DOC_COLS)
    return round_doubles(P.structural_issues(p))


LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@register("a01_profile_lineitem", f"""{stats_sql(long_sql('lineitem', LINEITEM_COLS))},
vc AS (SELECT "column", count(DISTINCT value) AS unique_count FROM long GROUP BY "column")
SELECT g."column", total_count, null_count, unique_count, data_type_guess,
       {r6(f"CASE WHEN data_type_guess = 'numeric' THEN {MEAN_6} END")} AS mean_value,
       {r6('1.0 - (null_count + empty_count) / CAST(total_count AS DOUBLE)')} AS completeness
FROM g JOIN vc ON g."column" = vc."column" """)
def q_profile_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A01/A03/A05 on the largest table: every cell of lineitem profiled."""
    p = P.profile_columns(table(spark, sf_dir, "lineitem"), LINEITEM_COLS)
    return round_doubles(p.select("column", "total_count", "null_count", "unique_count", "data_type_guess",
                                  F.col("mean_6").alias("mean_value"), "completeness"))
