"""Registered queries: lookups and domains joined from tables (P04, V04),
keyset pages, client scopes (O02, P16, P18), and rows for small operators
(A15, F15-F17, R03, S10, V12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetrina.functions import records as REC
from vetrina.functions.normalize import zero_as_null
from vetrina.operators import export as X
from vetrina.operators import quality as Q
from vetrina.operators.mapping import FieldMapping, Template, apply_template
from vetrina.operators.paging import page, token_of
from vetrina.operators.reports import tenant_scope
from vetrina.operators.rules import issues_long, validate
from vetrina.operators.suggest import ETIM_NUMERIC_PATTERN, suggest_rules_from_reference
from vetrina.plans.fixtures import raw_product, raw_product_sql
from vetrina.plans.q_export import catalogue
from vetrina.plans.q_quality import ISSUES_LONG_SQL, JOBS_SQL, jobs
from vetrina.plans.q_resolve import RESOLVE_SQL
from vetrina.plans.q_validation import validated_products
from vetrina.plans.registry import register
from vetrina.plans.sqlfrag import missing, strip
from vetrina.session import materialize, scratch_path
from vetrina.sources import staging as ST
from vetrina.sources.reference_data import ETIM_CLASS_FEATURES, ETIM_FEATURES, etim_class_feature_df, etim_feature_df
from vetrina.sources.tables import table

# --------------------------------------------------------------------------
# An article table with two spellings per key, made from orders.
# --------------------------------------------------------------------------
_ARTICLES = {"key": "case when o_orderkey % 2 = 0 then concat('prt-', lpad(cast({half} as {vc}), 6, '0')) else concat('PRT-', lpad(cast({half} as {vc}), 6, '0')) end",
             "value": "case when o_orderkey % 7 = 0 then null else concat('V', cast(o_orderkey as {vc})) end", "ordinal": "o_orderkey"}


def _articles(half: str, vc: str) -> list[str]:
    return [f"{e.format(half=half, vc=vc)} as {n}" for n, e in _ARTICLES.items()]


_ARTICLES_SQL = f"articles AS (SELECT {', '.join(_articles('o_orderkey // 2 * 3 // 2', 'varchar'))} FROM orders)"


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*_articles("(o_orderkey div 2 * 3) div 2", "string"))


LOOKUP_TEMPLATE = Template([FieldMapping("SKU", "sku"), FieldMapping("SKU", "model", "lookup", {"lookup_ref": "articles"}),
                            FieldMapping("SKU", "description", "lookup", {"lookup_ref": "articles", "default_value": "unknown"})], [])


@register("p04_lookup_join", f"""WITH {raw_product_sql()}, {_ARTICLES_SQL},
ex AS (SELECT key, arg_min(row(value), ordinal) AS v FROM articles GROUP BY key), ci AS (SELECT lower(key) AS low, arg_min(row(value), ordinal) AS v FROM articles GROUP BY ALL),
s AS (SELECT client_id, ingest_id, row_num, "SKU" AS raw, {missing('"SKU"')} AS gone, {strip('"SKU"')} AS key FROM raw_product),
j AS (SELECT s.*, ex.key IS NOT NULL OR ci.low IS NOT NULL AS hit, coalesce(ex.v, ci.v)[1] AS found FROM s LEFT JOIN ex ON s.key = ex.key LEFT JOIN ci ON lower(s.key) = ci.low)
SELECT client_id, ingest_id, row_num, CASE WHEN gone THEN NULL WHEN hit THEN found ELSE raw END AS model, CASE WHEN gone THEN NULL WHEN hit THEN found ELSE 'unknown' END AS description FROM j""")
def q_lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings that name a lookup table as large as the orders."""
    mapped = apply_template(raw_product(spark, sf_dir), LOOKUP_TEMPLATE, lookups={"articles": articles(spark, sf_dir)})
    return mapped.select("client_id", "ingest_id", "row_num", "product.model", "product.description")


def _domain_rule(rule_id: str, **config) -> dict:
    return {"rule_id": rule_id, "name": rule_id, "rule_type": "domain", "target_type": "field", "target_name": "sku", "severity": "ERROR", "is_active": True,
            "rule_config": {"values_ref": "articles", **config}}


@register("v04_domain_join", f"""WITH {raw_product_sql()}, {_ARTICLES_SQL},
s AS (SELECT client_id, ingest_id, row_num, {strip('"SKU"')} AS sku FROM raw_product WHERE NOT {missing('"SKU"')} AND {strip('"SKU"')} <> '')
SELECT client_id, ingest_id, row_num, 'exact' AS rule_id, sku AS value, 'Value ''' || sku || ''' is not in allowed list: articles' AS message FROM s WHERE sku NOT IN (SELECT key FROM articles)
UNION ALL
SELECT client_id, ingest_id, row_num, 'any_case', sku, 'Value ''' || sku || ''' is not in allowed list: articles' FROM s WHERE lower(sku) NOT IN (SELECT lower(key) FROM articles)""")
def q_domain_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain rules whose allowed values are a table."""
    mapped = materialize(apply_template(raw_product(spark, sf_dir), Template([FieldMapping("SKU", "sku")], [])), "mapped-sku")
    allowed = articles(spark, sf_dir).select(F.col("key").alias("value"))
    checked = validate(mapped, [_domain_rule("exact"), _domain_rule("any_case", case_sensitive=False)], domains={"articles": allowed})
    return issues_long(checked).select("client_id", "ingest_id", "row_num", "rule_id", "value", "message")


# --------------------------------------------------------------------------
# Pages and scopes.
# --------------------------------------------------------------------------
PAGE, PAGES = 50, 3


@register("o02_keyset_pages", f"""WITH {JOBS_SQL},
r AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, job_id DESC) AS k FROM jobs WHERE status = 'processing')
SELECT job_id, client_id, status, created_at, CAST((k - 1) // {PAGE} AS INTEGER) AS page FROM r WHERE k <= {PAGE * PAGES}""")
def q_keyset_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three pages of the job list, each from the token of the
    page before."""
    rows, keys = jobs(spark, sf_dir).where("status = 'processing'"), ["created_at", "job_id"]
    out, token = None, None
    for number in range(PAGES):
        one = page(rows, keys, PAGE, token).withColumn("page", F.lit(number))
        out = one if out is None else out.unionByName(one)
        token = token_of(one, keys, PAGE)
        if token is None:
            break
    return out


@register("p18_client_jobs", f"""WITH {JOBS_SQL}
SELECT job_id, status, created_at FROM jobs WHERE client_id = 7 AND status = 'completed'""")
def q_client_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs of one client in one state."""
    return jobs(spark, sf_dir).where("client_id = 7 and status = 'completed'").select("job_id", "status", "created_at")


@register("p16_tenant_scope", """
SELECT event_id, CASE WHEN user_id % 11 = 0 THEN 'global' ELSE 'c' || user_id END AS client_id FROM events WHERE user_id = 5 OR user_id % 11 = 0""")
def q_tenant_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one client and the shared ones."""
    client = F.when(F.col("user_id") % 11 == 0, "global").otherwise(F.concat(F.lit("c"), F.col("user_id").cast("string")))
    return tenant_scope(table(spark, sf_dir, "events").select("event_id", client.alias("client_id")), "c5")


# --------------------------------------------------------------------------
# Rows for small operators.
# --------------------------------------------------------------------------
@register("a15_issues_by_column", f"""{ISSUES_LONG_SQL}
SELECT client_id, ingest_id, coalesce(target_name, 'unknown') AS target_name, count(*) AS issue_count FROM long GROUP BY ALL""")
def q_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue counts by column."""
    return Q.issues_by(issues_long(validated_products(spark, sf_dir)), "target_name")


@register("f15_export_prices", "SELECT p_partkey, CASE WHEN p_size - 10 <> 0 THEN p_size - 10 END AS shown FROM part")
def q_export_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """zero and null both print as empty."""
    return table(spark, sf_dir, "part").select("p_partkey", zero_as_null(F.col("p_size") - 10).alias("shown"))


_LEFT = {"completed": "", "normalizing": "upload,normalization,execution,completion", "executing": "upload,execution,completion", "failed": ",".join(REC.ALL_STAGES), "odd": ",".join(REC.ALL_STAGES)}


@register("f16_remaining_stages", f"""
WITH j AS (SELECT o_orderkey AS job_id, o_orderdate AS started_at,
  CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'normalizing' WHEN o_orderkey % 3 = 0 THEN 'executing' WHEN o_orderkey % 3 = 1 THEN 'failed' ELSE 'odd' END AS status FROM orders)
SELECT job_id, status, CASE status {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _LEFT.items())} END AS remaining,
       CASE WHEN status = 'executing' THEN CAST(floor(epoch(started_at)) AS BIGINT) + 300 END AS estimated_end FROM j""")
def q_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: stages to come and the estimate of a running job."""
    status = F.expr("case when o_orderstatus = 'F' then 'completed' when o_orderstatus = 'O' and o_orderkey % 2 = 0 then 'normalizing' "
                    "when o_orderkey % 3 = 0 then 'executing' when o_orderkey % 3 = 1 then 'failed' else 'odd' end")
    j = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), status.alias("status"), F.col("o_orderdate").cast("timestamp").alias("started_at"))
    return j.select("job_id", "status", F.array_join(REC.remaining_stages("status"), ",").alias("remaining"),
                    F.unix_timestamp(REC.estimated_completion("status", "started_at")).alias("estimated_end"))


@register("f17_nested_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type AS last_type FROM events")
def q_nested_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """typed access along a nested path."""
    doc = F.concat(F.lit('{"a": {"b": '), F.col("props"), F.lit(', "list": ["x", "'), F.col("event_type"), F.lit('"]}}'))
    e = table(spark, sf_dir, "events").select("event_id", doc.alias("doc"))
    ddl = "a struct<b: struct<k: int>, list: array<string>>"
    return e.select("event_id", REC.json_field("doc", "$.a.b.k", ddl).alias("k"), REC.json_field("doc", "$.a.list[1]", ddl).alias("last_type"))


@register("r03_standard_profile", f"""{RESOLVE_SQL}
SELECT product_id, sku, gtin, product_name, brand, CAST(NULL AS VARCHAR) AS description, etim_class, price, currency FROM prod""")
def q_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard profile columns."""
    return X.export_table(catalogue(spark, sf_dir, features=False)["products"], None, "standard")


_PAIRS = ", ".join(f"('{c}', '{f}', {str(bool(m)).lower()})" for c, f, m, *_ in ETIM_CLASS_FEATURES)
_TYPES = ", ".join(f"('{f[0]}', '{f[2]}')" for f in ETIM_FEATURES)


@register("v12_reference_rules", f"""WITH cf(class_code, feature_code, mandatory) AS (VALUES {_PAIRS}), ft(feature_code, data_type) AS (VALUES {_TYPES}),
c AS (SELECT CASE p_type WHEN 'SMALL' THEN 'EC000123' WHEN 'MEDIUM' THEN 'EC000123' WHEN 'LARGE' THEN 'EC000456' WHEN 'STANDARD' THEN 'EC000001' ELSE p_type END AS class_code, count(*) AS n FROM part GROUP BY ALL),
s AS (SELECT cf.class_code, cf.feature_code, 'etim_required' AS suggestion, 'required' AS rule_type, NULL AS pattern, 1.0::DOUBLE AS confidence FROM cf JOIN ft USING (feature_code) WHERE mandatory
      UNION ALL SELECT cf.class_code, cf.feature_code, 'etim_numeric', 'format', '{ETIM_NUMERIC_PATTERN}', 0.95 FROM cf JOIN ft USING (feature_code) WHERE data_type = 'N')
SELECT s.*, 'ERROR' AS severity, n AS n_products FROM s JOIN c USING (class_code)""")
def q_reference_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules the reference data suggests for the classes that the
    products have, with the number of products each would check."""
    kind = F.expr("case p_type when 'SMALL' then 'EC000123' when 'MEDIUM' then 'EC000123' when 'LARGE' then 'EC000456' when 'STANDARD' then 'EC000001' else p_type end")
    used = table(spark, sf_dir, "part").groupBy(kind.alias("class_code")).agg(F.count(F.lit(1)).alias("n_products"))
    return suggest_rules_from_reference(etim_class_feature_df(spark), etim_feature_df(spark)).join(used, "class_code")


@register("s10_skewed_staging", """
SELECT CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE 'c' || (user_id % 5) END AS client_id, CASE WHEN event_id % 3 = 0 THEN 'one' ELSE 'i' || (user_id % 4) END AS ingest_id,
       count(*) AS n_rows, sum(event_id)::BIGINT AS row_sum, CASE WHEN event_id % 3 = 0 THEN true ELSE NULL END AS several_files
FROM events GROUP BY ALL""")
def q_skewed_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staging with a third of all rows in one ingest, which several
    tasks write; read back per ingest."""
    hot = F.col("event_id") % 3 == 0
    rows = table(spark, sf_dir, "events").select(F.when(hot, "hot").otherwise(F.concat(F.lit("c"), (F.col("user_id") % 5).cast("string"))).alias("client_id"),
                                                 F.when(hot, "one").otherwise(F.concat(F.lit("i"), (F.col("user_id") % 4).cast("string"))).alias("ingest_id"), F.col("event_id").alias("row_num"))
    path = scratch_path(spark, "staging-skew")
    ST.write_staging(rows, path, partitions=8)
    back = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("file"))
    files = F.count_distinct("file")
    out = back.groupBy("client_id", "ingest_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("row_num").alias("row_sum"), files.alias("files"))
    return out.select("client_id", "ingest_id", "n_rows", "row_sum", F.when(F.col("client_id") == "hot", F.col("files") > 1).alias("several_files"))
