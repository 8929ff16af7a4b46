"""Registered queries: imports against a stored catalogue (E06-E10, E12) and
the incremental export (P17).

The feed reads ``events`` as 36 supplier files: three clients with twelve
ingests each (ing-0 to ing-11, so text order is not order of arrival), files
of the last client arriving first, row numbers from 0 in every file, and each
SKU in many rows of many files.  A user is an article that all clients sell
under one GTIN.  Ingests 0 to 7 are the first import, 8 to 11 the second;
some articles come only in one of them, some come again unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetrina.operators import export as X
from vetrina.operators import resolve as R
from vetrina.operators.upsert import CHANGES, latest, upsert
from vetrina.plans.registry import register
from vetrina.session import materialize
from vetrina.sources.tables import table

FILES, CLIENTS, FIRST = 36, 3, 8
T0 = 1_704_067_200  # 2024-01-01 00:00:00 UTC
T1, T2 = T0 + 360_000, T0 + 720_000  # times of the imports

_FEED = [
    ("client_id", f"concat('c', cast(event_id % {CLIENTS} as {{vc}}))"),
    ("ing", f"cast(event_id % {FILES} as bigint) {{div}} {CLIENTS}"),
    ("row_num", f"cast(event_id as bigint) {{div}} {FILES}"),
    ("u", "cast(user_id as bigint)"),
    ("price", "case when event_type = 'error' then null when user_id % 5 = 2 then '9.99' else cast(cast(value as decimal(12,2)) as {vc}) end"),
    ("description", "case when event_type = 'click' then concat('seen ', cast(event_id as {vc})) end"),
]
_COLUMNS = {
    "ingest_id": "concat('ing-', cast(ing as {vc}))", "arrived": f"{T0} + ing * 3600 - cast(substr(client_id, 2, 1) as int) * 600",
    "sku": "concat(upper(client_id), '-', cast(u as {vc}))", "gtin": "lpad(cast(u + 1 as {vc}), 13, '0')",
    "product_name": "concat('Item ', cast(u as {vc}))", "brand": "concat('Brand ', cast(u % 25 as {vc}))", "etim_class": "case when u % 2 = 0 then 'EC000123' else 'EC000456' end",
    "etim_feature": "concat('EF', cast(row_num % 4 as {vc}))", "row_key": "cast(row_num as {vc})",
}
#: Which articles each import brings.
_FIRST, _SECOND = f"ing < {FIRST} and u % 7 <> 1", f"ing >= {FIRST} and u % 3 <> 0 and (u % 5 <> 2 or price is not null and description is null)"


def _cells(cells, vc: str, div: str) -> str:
    return ", ".join(f"{e.format(vc=vc, div=div)} as {n}" for n, e in cells)


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_id is not null and user_id is not null")
    rows = rows.selectExpr(*[f"{e.format(vc='string', div='div')} as {n}" for n, e in _FEED])
    rows = rows.selectExpr("*", *[f"{e.format(vc='string')} as {n}" for n, e in _COLUMNS.items()])
    return rows.withColumn("arrived_at", F.timestamp_seconds("arrived"))


_FEED_SQL = f"""WITH f0 AS (SELECT {_cells(_FEED, 'varchar', '//')} FROM events WHERE event_id IS NOT NULL AND user_id IS NOT NULL),
feed AS (SELECT *, {_cells(_COLUMNS.items(), 'varchar', '//')} FROM f0),
one AS (SELECT *, row(arrived, ingest_id, row_num, client_id, sku) AS seq FROM feed WHERE {_FIRST}),
two AS (SELECT *, row(arrived, ingest_id, row_num, client_id, sku) AS seq FROM feed WHERE {_SECOND}),
rep1 AS (SELECT u, arg_min(sha256(client_id || '|' || sku), seq) AS product_id, arg_min(client_id, seq) AS client_id, arg_min(sku, seq) AS sku FROM one GROUP BY u),
rep2 AS (SELECT u, arg_min(sha256(client_id || '|' || sku), seq) AS product_id, arg_min(client_id, seq) AS client_id, arg_min(sku, seq) AS sku FROM two GROUP BY u),
ids AS (SELECT u, coalesce(a.product_id, b.product_id) AS product_id, coalesce(a.client_id, b.client_id) AS client_id, coalesce(a.sku, b.sku) AS sku,
          a.u IS NOT NULL AS old, b.u IS NOT NULL AS new FROM rep1 a FULL JOIN rep2 b USING (u)),
v1 AS (SELECT u, arg_max(price, CASE WHEN price IS NOT NULL THEN seq END) AS price, arg_max(description, CASE WHEN description IS NOT NULL THEN seq END) AS description, arg_max(ingest_id, seq) AS ingest_id FROM one GROUP BY u),
v2 AS (SELECT u, arg_max(price, CASE WHEN price IS NOT NULL THEN seq END) AS price, arg_max(description, CASE WHEN description IS NOT NULL THEN seq END) AS description, arg_max(ingest_id, seq) AS ingest_id FROM two GROUP BY u),
prod AS (SELECT ids.*, v1.price AS price1, coalesce(v2.price, v1.price) AS price, v1.description AS description1, coalesce(v2.description, v1.description) AS description, coalesce(v2.ingest_id, v1.ingest_id) AS ingest_id,
           CASE WHEN NOT old THEN 'insert' WHEN NOT new THEN 'keep'
                WHEN v1.price IS NOT DISTINCT FROM coalesce(v2.price, v1.price) AND v1.description IS NOT DISTINCT FROM coalesce(v2.description, v1.description) THEN 'same' ELSE 'replace' END AS change
         FROM ids LEFT JOIN v1 USING (u) LEFT JOIN v2 USING (u)),
f1 AS (SELECT ids.product_id, etim_feature, arg_max(row_key, seq) AS value_raw FROM one JOIN ids ON one.u = ids.u GROUP BY ALL),
f2 AS (SELECT ids.product_id, etim_feature, arg_max(row_key, seq) AS value_raw FROM two JOIN ids ON two.u = ids.u GROUP BY ALL)"""


def features_of(batch: DataFrame) -> DataFrame:
    """One feature value a row, as normalisation gives them."""
    return batch.select("client_id", "sku", "ingest_id", "row_num", "arrived_at", F.lit(0).alias("pos"), "etim_feature", F.col("row_key").alias("value_raw"),
                        F.lit("mm").alias("unit_raw"), F.col("row_key").alias("value_normalized"), F.lit("mm").alias("unit_normalized"))


def imports(spark: SparkSession, sf_dir: str) -> tuple[dict, dict, dict]:
    """(state after the first import, after the second, counts of the second)."""
    rows = materialize(feed(spark, sf_dir), "feed")
    state, counts = None, {}
    states = []
    for part, when in ((_FIRST, T1), (_SECOND, T2)):
        batch = rows.where(part)
        state, counts = R.import_batch(batch, features_of(batch), state, F.timestamp_seconds(F.lit(when)))
        states.append(state)
    return (*states, counts)


def _seconds(c: str):
    return F.unix_timestamp(c).alias(c)


@register("e06_import_snapshot", f"""{_FEED_SQL}
SELECT product_id, client_id, sku, price, description, ingest_id, change, CASE WHEN old THEN {T1} ELSE {T2} END AS created_at,
       CASE WHEN change IN ('insert', 'replace') THEN {T2} ELSE {T1} END AS updated_at FROM prod""")
def q_import_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products after a second import into a stored catalogue; the
    value that arrived last wins, whatever the text order of the ingests."""
    products = imports(spark, sf_dir)[1]["products"]
    return products.select("product_id", "client_id", "sku", "price", "description", "ingest_id", "change", _seconds("created_at"), _seconds("updated_at"))


@register("e07_feature_upsert", f"""{_FEED_SQL}
SELECT coalesce(f1.product_id, f2.product_id) AS product_id, coalesce(f1.etim_feature, f2.etim_feature) AS etim_feature, coalesce(f2.value_raw, f1.value_raw) AS value_raw,
       CASE WHEN f1.product_id IS NULL THEN 'insert' WHEN f2.product_id IS NULL THEN 'keep' WHEN f1.value_raw = f2.value_raw THEN 'same' ELSE 'replace' END AS change,
       CASE WHEN f2.value_raw IS NULL OR f1.value_raw = f2.value_raw THEN {T1} ELSE {T2} END AS updated_at
FROM f1 FULL JOIN f2 ON f1.product_id = f2.product_id AND f1.etim_feature = f2.etim_feature""")
def q_feature_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature values after the second import."""
    return imports(spark, sf_dir)[1]["features"].select("product_id", "etim_feature", "value_raw", "change", _seconds("updated_at"))


@register("e08_crosswalk_upsert", f"""{_FEED_SQL},
k1 AS (SELECT DISTINCT u, client_id, sku FROM one), k2 AS (SELECT DISTINCT u, client_id, sku FROM two)
SELECT coalesce(k1.client_id, k2.client_id) AS client_id, coalesce(k1.sku, k2.sku) AS src_key, ids.product_id,
       CASE WHEN k1.u IS NULL THEN 'insert' WHEN k2.u IS NULL THEN 'keep' ELSE 'same' END AS change, CASE WHEN k1.u IS NULL THEN {T2} ELSE {T1} END AS created_at
FROM k1 FULL JOIN k2 ON k1.client_id = k2.client_id AND k1.sku = k2.sku JOIN ids ON ids.u = coalesce(k1.u, k2.u)""")
def q_crosswalk_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crosswalk after the second import."""
    return imports(spark, sf_dir)[1]["crosswalk"].select("client_id", "src_key", "product_id", "change", _seconds("created_at"))


_FILE_ROWS = "client_id, ingest_id, max(arrived) AS arrived, count(*) AS n_rows"


@register("e09_file_records", f"""{_FEED_SQL},
a AS (SELECT {_FILE_ROWS} FROM feed WHERE ing < {FIRST} GROUP BY ALL), b AS (SELECT client_id, ingest_id, max(arrived) + 7 AS arrived, count(*) AS n_rows FROM feed WHERE ing >= 6 GROUP BY ALL)
SELECT coalesce(a.client_id, b.client_id) AS client_id, coalesce(a.ingest_id, b.ingest_id) AS ingest_id, coalesce(b.arrived, a.arrived) AS arrived, coalesce(b.n_rows, a.n_rows) AS n_rows,
       CASE WHEN a.client_id IS NULL THEN 'insert' WHEN b.client_id IS NULL THEN 'keep' ELSE 'replace' END AS change,
       CASE WHEN a.client_id IS NULL THEN {T2} ELSE {T1} END AS created_at, CASE WHEN b.client_id IS NULL THEN {T1} ELSE {T2} END AS updated_at
FROM a FULL JOIN b ON a.client_id = b.client_id AND a.ingest_id = b.ingest_id""")
def q_file_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File records keyed (client_id, ingest_id); files 6 and 7 are
    registered again with another time and replace their record."""
    rows = feed(spark, sf_dir)
    files = lambda part, late: rows.where(part).groupBy("client_id", "ingest_id").agg((F.max("arrived") + late).alias("arrived"), F.count(F.lit(1)).alias("n_rows"))
    keys, values = ["client_id", "ingest_id"], ["arrived", "n_rows"]
    stored = upsert(None, files(f"ing < {FIRST}", 0), keys, values, F.timestamp_seconds(F.lit(T1))).drop("change")
    again = upsert(stored, files("ing >= 6", 7), keys, values, F.timestamp_seconds(F.lit(T2)))
    return again.select(*keys, *values, "change", _seconds("created_at"), _seconds("updated_at"))


@register("e10_seed_rows", f"""{_FEED_SQL},
s AS (SELECT u, arg_max(coalesce(description, 'never clicked'), seq) AS first_seen FROM (SELECT *, row(-arrived, sku, -row_num) AS seq FROM feed) GROUP BY u)
SELECT u AS article, first_seen, {T1} AS created_at, 'keep' AS change FROM s""")
def q_seed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed rows applied twice equal seed rows applied once, with the
    stamps of the first time."""
    rows = feed(spark, sf_dir).withColumn("late", -F.col("arrived")).withColumn("back", -F.col("row_num"))
    seeds = latest(rows.select(F.col("u").alias("article"), F.coalesce("description", F.lit("never clicked")).alias("first_seen"), "late", "sku", "back"), ["article"], ["late", "sku", "back"])
    once = upsert(None, seeds, ["article"], ["first_seen"], F.timestamp_seconds(F.lit(T1)), "nothing").drop("change")
    changed = seeds.withColumn("first_seen", F.lit("never stored"))
    twice = upsert(once, changed, ["article"], ["first_seen"], F.timestamp_seconds(F.lit(T2)), "nothing")
    return twice.select("article", "first_seen", _seconds("created_at"), "change")


_COUNTS = ["created", "merged", "matched", "failed", *[f"{t}_{c}" for t in ("products", "features", "crosswalk") for c in CHANGES]]


@register("e12_import_counts", f"""{_FEED_SQL},
k1 AS (SELECT DISTINCT client_id, sku FROM one), k2 AS (SELECT u, client_id, sku, min(seq) AS seq FROM two GROUP BY ALL),
rec AS (SELECT k2.*, k1.sku IS NOT NULL AS hit, ids.old, sha256(k2.client_id || '|' || k2.sku) = ids.product_id AS own FROM k2 LEFT JOIN k1 USING (client_id, sku) JOIN ids ON ids.u = k2.u),
f AS (SELECT CASE WHEN f1.product_id IS NULL THEN 'insert' WHEN f2.product_id IS NULL THEN 'keep' WHEN f1.value_raw = f2.value_raw THEN 'same' ELSE 'replace' END AS change
      FROM f1 FULL JOIN f2 ON f1.product_id = f2.product_id AND f1.etim_feature = f2.etim_feature),
x AS (SELECT CASE WHEN k1.sku IS NULL THEN 'insert' WHEN k2.sku IS NULL THEN 'keep' ELSE 'same' END AS change FROM k1 FULL JOIN k2 USING (client_id, sku))
SELECT (SELECT count(*) FROM rec WHERE NOT hit AND NOT old AND own) AS created, (SELECT count(*) FROM rec WHERE NOT hit AND (old OR NOT own)) AS merged, (SELECT count(*) FROM rec WHERE hit) AS matched, CAST(0 AS BIGINT) AS failed,
{', '.join(f"(SELECT count(*) FROM {src} WHERE change = '{c}') AS {t}_{c}" for t, src in (('products', 'prod'), ('features', 'f'), ('crosswalk', 'x')) for c in CHANGES)}""")
def q_import_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second import did, observed while its tables were written."""
    counts = imports(spark, sf_dir)[2]
    return spark.createDataFrame([tuple(counts[c] for c in _COUNTS)], ", ".join(f"{c} long" for c in _COUNTS))


@register("p17_incremental_export", f"""{_FEED_SQL}
SELECT p.product_id, p.sku, p.price, p.description, {T2} AS updated_at FROM prod p
WHERE change IN ('insert', 'replace') AND u % 2 = 0 AND 'Brand ' || (u % 25) = 'Brand 4'
  AND EXISTS (SELECT 1 FROM one WHERE one.u = p.u AND one.client_id = 'c1' UNION ALL SELECT 1 FROM two WHERE two.u = p.u AND two.client_id = 'c1')""")
def q_incremental_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The products of a client, class and brand that changed since the
    second import began, and no others."""
    state = imports(spark, sf_dir)[1]
    since = F.timestamp_seconds(F.lit(T2))
    out = X.export_filter(state["products"], state["crosswalk"], "c1", etim_class="EC000123", brand="Brand 4", updated_since=since)
    return out.select("product_id", "sku", "price", "description", _seconds("updated_at"))
