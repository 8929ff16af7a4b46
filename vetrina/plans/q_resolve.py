"""Registered queries: entity resolution and upsert.

The batch is the whole ``raw_product`` file after mapping and
normalisation.  Rows p and p + 1500 share a GTIN (the fixture's GTIN
repeats), so within-batch GTIN blocking has real candidates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetrina.operators.mapping import apply_template
from vetrina.operators.normalization import normalize_products
from vetrina.operators import resolve as R
from vetrina.plans.fixtures import raw_product, raw_product_sql
from vetrina.plans.q_mapping import FULL_TEMPLATE
from vetrina.plans.q_normalize import sql_currency, sql_gtin, sql_price, sql_text
from vetrina.plans.registry import register, round_doubles
from vetrina.plans.sqlfrag import missing, r6, strip
from vetrina.session import materialize
from vetrina.sources.reference_data import uom_df


def mapped_full(spark: SparkSession, sf_dir: str, price_bump: float | None = None) -> DataFrame:
    """Mapped rows (cut point: feeds validation, normalisation, features)."""
    raw = raw_product(spark, sf_dir, materialized=True)
    if price_bump is not None:
        # A second supplier file: same SKUs, prices raised.
        raw = raw.withColumn("Price", F.format_string("%.2f", F.col("Price").cast("double") + price_bump))
    return materialize(apply_template(raw, FULL_TEMPLATE, uom=uom_df(spark)), "mapped")


def normalized_batch(spark: SparkSession, sf_dir: str, price_bump: float | None = None,
                     mapped: DataFrame | None = None) -> DataFrame:
    """Normalised rows of the mapped file, materialised as a cut point."""
    m = mapped if mapped is not None else mapped_full(spark, sf_dir, price_bump)
    return materialize(normalize_products(m), "normalized-batch")


def first_import(spark, sf_dir):
    res = R.resolve(normalized_batch(spark, sf_dir))
    return res


def _words(x: str) -> str:
    s = f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"
    return f"(CASE WHEN {s} = '' THEN []::VARCHAR[] ELSE list_distinct(string_split({s}, ' ')) END)"


def _jaccard(a: str, b: str) -> str:
    wa, wb = _words(a), _words(b)
    u = f"len(list_distinct(list_concat({wa}, {wb})))"
    return (f"(CASE WHEN len({wa}) = 0 OR len({wb}) = 0 OR {u} = 0 THEN 0.0 "
            f"ELSE len(list_intersect({wa}, {wb})) / CAST({u} AS DOUBLE) END)")


def _ne(x: str) -> str:
    return f"({x} IS NOT NULL AND {x} <> '')"


def _sim(n1, b1, c1, n2, b2, c2) -> str:
    return (f"((CASE WHEN {_ne(n1)} AND {_ne(n2)} THEN {_jaccard(n1, n2)} * 0.4 ELSE 0.0 END)"
            f" + (CASE WHEN {_ne(b1)} AND {_ne(b2)} THEN (CASE WHEN lower({b1}) = lower({b2}) THEN 0.3 "
            f"ELSE {_jaccard(b1, b2)} * 0.3 END) ELSE 0.0 END)"
            f" + (CASE WHEN {_ne(c1)} AND {_ne(c2)} AND {c1} = {c2} THEN 0.3 ELSE 0.0 END))")


_CLASS = ("CASE p_type WHEN 'SMALL' THEN 'EC000123' WHEN 'MEDIUM' THEN 'EC000123' "
          "WHEN 'LARGE' THEN 'EC000456' WHEN 'STANDARD' THEN 'EC000001' ELSE p_type END")


def _mapped(x: str) -> str:
    return f"(CASE WHEN {missing(x)} THEN NULL ELSE {strip(x)} END)"


RESOLVE_BODY = f"""n AS (
  SELECT client_id, ingest_id, row_num,
    CASE WHEN {missing('"SKU"')} THEN NULL ELSE upper({sql_text(_mapped('"SKU"'))}) END AS sku_n,
    {sql_gtin(_mapped('"GTIN"'))} AS gtin_n,
    CASE WHEN {missing('"Name"')} THEN NULL ELSE {sql_text(_mapped('"Name"'))} END AS name_n,
    CASE WHEN {missing('"Brand"')} THEN NULL ELSE {sql_text(_mapped('"Brand"'))} END AS brand_n,
    {sql_price(_mapped('"Price"'))} AS price_n,
    CASE WHEN {missing('"Currency"')} THEN NULL ELSE {sql_currency(_mapped('"Currency"'))} END AS currency_n,
    {_CLASS} AS class_n
  FROM raw_product),
rec AS (SELECT *, sha256(client_id || '|' || sku_n) AS own_id FROM n WHERE {_ne('sku_n')}),
rep AS (SELECT gtin_n, own_id AS rep_id, row_num AS rep_row, name_n AS rep_name, brand_n AS rep_brand,
               class_n AS rep_class
        FROM (SELECT *, row_number() OVER (PARTITION BY gtin_n ORDER BY row_num, client_id, sku_n) AS rk
              FROM rec WHERE {_ne('gtin_n')} AND NOT regexp_full_match(gtin_n, '0+')) WHERE rk = 1),
j AS (
  SELECT rec.*, rep.rep_id,
    CASE WHEN rep.rep_id IS NOT NULL AND NOT (rep.rep_row = rec.row_num AND rep.rep_id = rec.own_id)
         THEN {_sim('name_n', 'brand_n', 'class_n', 'rep_name', 'rep_brand', 'rep_class')} END AS score
  FROM rec LEFT JOIN rep ON rec.gtin_n = rep.gtin_n),
r AS (
  SELECT *, CASE WHEN score >= 0.8 THEN rep_id ELSE own_id END AS product_id,
         CASE WHEN score >= 0.8 THEN 'merged' ELSE 'created' END AS action
  FROM j),
prod AS (
  SELECT product_id,
    arg_min(client_id, CASE WHEN action <> 'merged' THEN row_num END) AS client_id,
    arg_min(sku_n, CASE WHEN action <> 'merged' THEN row_num END) AS sku,
    arg_max(gtin_n, CASE WHEN gtin_n IS NOT NULL THEN row_num END) AS gtin,
    arg_max(name_n, CASE WHEN name_n IS NOT NULL THEN row_num END) AS product_name,
    arg_max(brand_n, CASE WHEN brand_n IS NOT NULL THEN row_num END) AS brand,
    arg_max(price_n, CASE WHEN price_n IS NOT NULL THEN row_num END) AS price,
    arg_max(currency_n, CASE WHEN currency_n IS NOT NULL THEN row_num END) AS currency,
    arg_max(class_n, CASE WHEN class_n IS NOT NULL THEN row_num END) AS etim_class,
    max(row_num) AS seq, count(*) AS n_records
  FROM r GROUP BY product_id)"""
RESOLVE_SQL = f"WITH {raw_product_sql()},\n{RESOLVE_BODY}"


@register("e02_gtin_resolution", f"""WITH {RESOLVE_SQL.split('WITH ', 1)[1]}
SELECT client_id, sku_n AS sku, row_num AS first_row, product_id, action, {r6('score')} AS score FROM r""")
def q_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crosswalk (none yet), GTIN blocking with one representative
    per GTIN, similarity gate 0.8, deterministic ids."""
    rec = first_import(spark, sf_dir)["records"]
    return round_doubles(rec.select("client_id", "sku", "first_row", "product_id", "action", "score"))


@register("e12_upsert_counts", f"""WITH {RESOLVE_SQL.split('WITH ', 1)[1]},
c AS (SELECT client_id, count(*) FILTER (WHERE action = 'created') AS created,
             count(*) FILTER (WHERE action = 'merged') AS merged, CAST(0 AS BIGINT) AS matched
      FROM r GROUP BY client_id),
f AS (SELECT client_id, count(*) AS failed FROM n WHERE NOT {_ne('sku_n')} GROUP BY client_id)
SELECT coalesce(c.client_id, f.client_id) AS client_id, coalesce(created, 0) AS created,
       coalesce(merged, 0) AS merged, coalesce(matched, 0) AS matched, coalesce(failed, 0) AS failed
FROM c FULL JOIN f ON c.client_id = f.client_id""")
def q_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Created / merged / matched / failed per client."""
    res = first_import(spark, sf_dir)
    return R.action_counts(res["records"], res["failures"])


@register("e06_product_snapshot", f"""{RESOLVE_SQL}
SELECT product_id, client_id, sku, gtin, product_name, brand, price, n_records FROM prod""")
def q_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product snapshot after the first import."""
    res = first_import(spark, sf_dir)
    recs = res["records"]
    prods = R.upsert_products(recs)
    n = recs.groupBy("product_id").agg(F.count("*").alias("n_records"))
    return prods.join(n, "product_id").select("product_id", "client_id", "sku", "gtin", "product_name",
                                              "brand", "price", "n_records")


@register("e01_reimport_crosswalk", f"""WITH {RESOLVE_SQL.split('WITH ', 1)[1]},
cw AS (SELECT client_id, sku_n, product_id FROM r),
second AS (SELECT n.client_id, n.sku_n, n.row_num,
                  CAST(round_even(CAST(n.price_n AS DOUBLE) + 1.5, 2) AS DECIMAL(38,2)) AS price2
           FROM n WHERE {_ne('n.sku_n')})
SELECT cw.product_id, arg_max(s.price2, s.row_num) AS price, count(*) AS n_matched
FROM second s JOIN cw ON s.client_id = cw.client_id AND s.sku_n = cw.sku_n
GROUP BY cw.product_id""")
def q_reimport(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second file with the same SKUs matches every record
    through the crosswalk built by the first import; prices are updated
    with ``coalesce(new, old)``."""
    first = first_import(spark, sf_dir)["records"]
    base = R.upsert_products(first)
    cw = R.upsert_crosswalk(first)
    second = R.resolve(normalized_batch(spark, sf_dir, price_bump=1.5), base, cw)["records"]
    prods = R.upsert_products(second, base)
    n = second.groupBy("product_id").agg(F.count("*").alias("n_matched"))
    return prods.join(n, "product_id").select("product_id", "price", "n_matched")


# --------------------------------------------------------------------------
# A second supplier selling the same parts: own SKUs (no crosswalk hit),
# same GTINs, names without the size suffix, brand in upper case.
# --------------------------------------------------------------------------
def second_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_product(spark, sf_dir)
    raw = (raw.withColumn("SKU", F.concat(F.lit("alt-"), F.col("row_num").cast("string")))
              .withColumn("Name", F.regexp_replace("Name", r"\s+XL$", ""))
              .withColumn("Brand", F.upper("Brand")))
    mapped = materialize(apply_template(raw, FULL_TEMPLATE, uom=uom_df(spark)), "mapped")
    return materialize(normalize_products(mapped), "normalized-batch")


@register("e02_cross_supplier_merge", f"""WITH {RESOLVE_SQL.split('WITH ', 1)[1]},
base AS (SELECT product_id,
           arg_max(gtin_n, CASE WHEN gtin_n IS NOT NULL THEN row_num END) AS gtin,
           arg_max(name_n, CASE WHEN name_n IS NOT NULL THEN row_num END) AS pname,
           arg_max(brand_n, CASE WHEN brand_n IS NOT NULL THEN row_num END) AS pbrand,
           arg_max(class_n, CASE WHEN class_n IS NOT NULL THEN row_num END) AS pclass
         FROM r GROUP BY product_id),
brep AS (SELECT gtin, min(product_id) AS rep_id FROM base
         WHERE {_ne('gtin')} AND NOT regexp_full_match(gtin, '0+') GROUP BY gtin),
b AS (SELECT brep.gtin, brep.rep_id, base.pname, base.pbrand, base.pclass
      FROM brep JOIN base ON base.product_id = brep.rep_id),
s AS (SELECT client_id, row_num, upper('alt-' || CAST(row_num AS VARCHAR)) AS sku2, gtin_n,
             regexp_replace(name_n, ' XL$', '') AS name2, upper(brand_n) AS brand2, class_n
      FROM n),
m AS (SELECT s.*, b.rep_id,
        CASE WHEN b.rep_id IS NOT NULL THEN {_sim('name2', 'brand2', 'class_n', 'b.pname', 'b.pbrand', 'b.pclass')} END AS score
      FROM s LEFT JOIN b ON s.gtin_n = b.gtin)
SELECT client_id, sku2 AS sku, row_num AS first_row,
       CASE WHEN score >= 0.8 THEN rep_id ELSE sha256(client_id || '|' || sku2) END AS product_id,
       CASE WHEN score >= 0.8 THEN 'merged' ELSE 'created' END AS action, {r6('score')} AS score
FROM m""")
def q_cross_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a second supplier match the catalogue by GTIN
    (one base representative per GTIN) and merge when similar enough."""
    first = first_import(spark, sf_dir)["records"]
    base = R.upsert_products(first)
    cw = R.upsert_crosswalk(first)
    rec = R.resolve(second_supplier(spark, sf_dir), base, cw)["records"]
    return round_doubles(rec.select("client_id", "sku", "first_row", "product_id", "action", "score"))
