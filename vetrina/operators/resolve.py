"""Entity resolution and snapshot upsert.

Set-based restatement of the reference's row-by-row persistence:

1. rows without a SKU are isolated as failures (E05/E11);
2. within the batch, rows sharing (client_id, sku) collapse to one record:
   per column the last non-null value in order of arrival (E06);
3. E01: the crosswalk (client_id, sku) gives an existing product id;
4. E02/E03: otherwise the GTIN is the blocking key.  Each GTIN has ONE
   representative: the base product with the smallest id, else the
   batch's record with the lowest row_num.  A record merges into its
   representative when the similarity score is at least 0.8, else it
   creates a product.  Comparing with one representative (not all
   products of the GTIN) follows the reference's ``LIMIT 1`` probe and
   keeps a hot GTIN from producing all pairs;
5. E05: created products get ``sha2(client_id | sku)`` as id;
6. E06-E08: products, features and crosswalk are upserted into a new
   snapshot by one full outer join each (``upsert``).

Shuffles: one aggregation on (client_id, sku), one on gtin for the
representatives, and joins on (client_id, sku) / gtin / product_id.  A
skewed GTIN is one row on the representative side, so AQE's skew-join
split applies to the batch side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetrina.operators.upsert import change_counts, upsert, write_counted

DEDUP_THRESHOLD = 0.8
NAME_WEIGHT, BRAND_WEIGHT, CLASS_WEIGHT = 0.4, 0.3, 0.3
UPDATABLE = ["gtin", "product_name", "brand", "model", "description", "etim_class", "price",
             "list_price", "cost_price", "currency", "length", "width", "height", "weight"]
PRODUCT_COLUMNS = ["product_id", "client_id", "sku"] + UPDATABLE + ["status", "ingest_id"]


def words(c: Column) -> Column:
    """Lower-cased whitespace-split word set (Python ``str.split()``)."""
    s = F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(s, " ")))


def jaccard_sets(wa: Column, wb: Column) -> Column:
    """E04 on word sets already computed: |A ∩ B| / |A ∪ B|, 0 when either
    is empty."""
    u = F.size(F.array_union(wa, wb))
    return F.when((F.size(wa) == 0) | (F.size(wb) == 0) | (u == 0), F.lit(0.0)) \
            .otherwise(F.size(F.array_intersect(wa, wb)) / u)


def jaccard(a: Column, b: Column) -> Column:
    """Word Jaccard of two texts."""
    return jaccard_sets(words(a), words(b))


def _nonempty(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def similarity(n1, b1, c1, n2, b2, c2, nw1=None, bw1=None, nw2=None, bw2=None) -> Column:
    """0.4 * name Jaccard + 0.3 * brand (equal -> 1, else Jaccard)
    + 0.3 * (class equal); a part missing on either side adds 0.  Word
    sets may be passed precomputed (``nw*``, ``bw*``)."""
    nw1 = words(n1) if nw1 is None else nw1
    nw2 = words(n2) if nw2 is None else nw2
    bw1 = words(b1) if bw1 is None else bw1
    bw2 = words(b2) if bw2 is None else bw2
    name = F.when(_nonempty(n1) & _nonempty(n2), jaccard_sets(nw1, nw2) * NAME_WEIGHT).otherwise(0.0)
    brand = F.when(_nonempty(b1) & _nonempty(b2),
                   F.when(F.lower(b1) == F.lower(b2), F.lit(BRAND_WEIGHT))
                    .otherwise(jaccard_sets(bw1, bw2) * BRAND_WEIGHT)).otherwise(0.0)
    cls = F.when(_nonempty(c1) & _nonempty(c2) & (c1 == c2), F.lit(CLASS_WEIGHT)).otherwise(0.0)
    return name + brand + cls


def product_id(client: Column, sku: Column) -> Column:
    return F.sha2(F.concat_ws("|", client, sku), 256)


def arrival(df: DataFrame, *ties: str) -> Column:
    """Order of arrival of a row: the time its file came in, then the ingest
    and the row number within it (which starts at 0 in every ingest).  Ingest
    ids are text, so without ``arrived_at`` ing-9 sorts after ing-10: pass the
    file's time (S01 modification time, E09 created_at) wherever there is one."""
    return F.struct(*[c for c in ("arrived_at",) if c in df.columns], "ingest_id", "row_num", *ties)


def collapse_batch(batch: DataFrame) -> DataFrame:
    """Step 2: one record per (client_id, sku); last non-null in order of arrival.

    ``seen`` holds the arrival of each column's value, so that records that
    merge into one product later compare value by value.  ``max_by`` is a
    partial aggregate, so a SKU repeated in a third of the rows is combined
    map-side before the shuffle."""
    cols = [c for c in UPDATABLE if c in batch.columns]
    rows = batch.withColumn("__at", arrival(batch))
    at = F.col("__at")
    rec = rows.groupBy("client_id", "sku").agg(
        F.min(at).alias("first_at"), F.max(at).alias("last_at"),
        F.struct(*[F.max(F.when(F.col(c).isNotNull(), at)).alias(c) for c in cols]).alias("seen"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in cols])
    return rec.select("*", F.col("first_at.row_num").alias("first_row"), F.col("last_at.row_num").alias("last_row"),
                      F.col("last_at.ingest_id").alias("ingest_id"))


def resolve(batch: DataFrame, base_products: DataFrame | None = None,
            crosswalk: DataFrame | None = None, threshold: float = DEDUP_THRESHOLD) -> dict:
    """Match a normalised batch against the catalogue.

    ``batch`` columns: client_id, ingest_id, row_num, sku and any of the
    updatable product columns.  Returns ``records`` (one per batch record:
    product_id, action created / merged / matched, score, matched_by) and
    ``failures`` (rows without SKU).
    """
    spark = batch.sparkSession
    ok = _nonempty(F.col("sku"))
    failures = batch.filter(~ok).select("client_id", "ingest_id", "row_num",
                                        F.lit("SKU is required").alias("error"))
    rec = collapse_batch(batch.filter(ok))
    for c in UPDATABLE:
        if c not in rec.columns:
            rec = rec.withColumn(c, F.lit(None).cast("string"))

    # Crosswalk hit.
    if crosswalk is not None:
        cw = crosswalk.select("client_id", F.col("src_key").alias("sku"),
                              F.col("product_id").alias("cw_product_id"))
        rec = rec.join(cw, ["client_id", "sku"], "left")
    else:
        rec = rec.withColumn("cw_product_id", F.lit(None).cast("string"))

    usable_gtin = _nonempty(F.col("gtin")) & ~F.col("gtin").rlike("^0+$")
    # Derived once per record: own id and the word sets of name and brand.
    rec = rec.select("*", product_id(F.col("client_id"), F.col("sku")).alias("__own"),
                     words(F.col("product_name")).alias("__nw"), words(F.col("brand")).alias("__bw"))
    # Representatives per GTIN: base first, then the batch's earliest record.
    own = F.struct(F.col("__own").alias("pid"), "product_name", "brand", "etim_class",
                   "__nw", "__bw")
    batch_rep = (rec.filter(usable_gtin & F.col("cw_product_id").isNull())
                 .groupBy("gtin").agg(F.min_by(own, F.struct("first_at", "client_id", "sku")).alias("br")))
    rep_cols = lambda p: [
        F.col(f"{p}.product_name").alias("rep_name"), F.col(f"{p}.brand").alias("rep_brand"),
        F.col(f"{p}.etim_class").alias("rep_class"), F.col(f"{p}.__nw").alias("rep_nw"),
        F.col(f"{p}.__bw").alias("rep_bw")]
    reps = batch_rep.select("gtin", F.col("br.pid").alias("rep_id"),
                            *rep_cols("br"))
    if base_products is not None:
        bp = (base_products.filter(usable_gtin).groupBy("gtin").agg(
            F.min_by(F.struct("product_id", "product_name", "brand", "etim_class"), "product_id").alias("b")))
        bp = bp.select("gtin", F.col("b.product_id").alias("rep_id"),
                       F.struct(F.col("b.product_name").alias("product_name"), F.col("b.brand").alias("brand"),
                                F.col("b.etim_class").alias("etim_class"),
                                words(F.col("b.product_name")).alias("__nw"),
                                words(F.col("b.brand")).alias("__bw")).alias("bb"))
        bp = bp.select("gtin", "rep_id", *rep_cols("bb"), F.lit(True).alias("rep_in_base"))
        reps = bp.unionByName(reps.withColumn("rep_in_base", F.lit(False)).join(bp.select("gtin"), "gtin", "left_anti"))
    else:
        reps = reps.withColumn("rep_in_base", F.lit(False))

    # Records that cannot match keep a key of their own: a left join would
    # hash all null GTINs into one task.
    probes = usable_gtin & F.col("cw_product_id").isNull()
    key = F.when(probes, F.col("gtin")).otherwise(F.concat(F.lit("-"), F.col("__own")))
    j = (rec.withColumn("__key", key)
         .join(reps.withColumnRenamed("gtin", "__key"), "__key", "left"))
    own_id = F.col("__own")
    is_rep_itself = (~F.col("rep_in_base")) & (F.col("rep_id") == own_id)
    score = F.when(F.col("rep_id").isNotNull() & ~F.coalesce(is_rep_itself, F.lit(False)),
                   similarity(F.col("product_name"), F.col("brand"), F.col("etim_class"),
                              F.col("rep_name"), F.col("rep_brand"), F.col("rep_class"),
                              F.col("__nw"), F.col("__bw"), F.col("rep_nw"), F.col("rep_bw")))
    j = j.withColumn("score", score)
    merged = F.col("cw_product_id").isNull() & F.col("score").isNotNull() & (F.col("score") >= threshold)
    pid = (F.when(F.col("cw_product_id").isNotNull(), F.col("cw_product_id"))
            .when(merged, F.col("rep_id")).otherwise(own_id))
    action = (F.when(F.col("cw_product_id").isNotNull(), "matched")
               .when(merged, "merged").otherwise("created"))
    by = (F.when(F.col("cw_product_id").isNotNull(), "crosswalk")
           .when(merged, "gtin").otherwise(F.lit(None)))
    records = j.select("client_id", "sku", "ingest_id", "first_row", "last_row", "first_at", "last_at", "seen", *UPDATABLE,
                       pid.alias("product_id"), action.alias("action"), by.alias("matched_by"),
                       F.col("score"))
    return {"records": records, "failures": failures}


def upsert_products(records: DataFrame, base_products: DataFrame | None = None, at: Column | None = None) -> DataFrame:
    """New product snapshot.

    Records that land on one product (merges, or several SKUs crosswalked
    to it) are combined first: per column the value that arrived last wins
    when not null (ties between clients: by client, sku).  Against the base,
    new non-null values replace old ones (``coalesce(new, old)``) and other
    rows pass through, in one full outer join.  With ``at``, the time of the
    import, the snapshot also has created_at, updated_at, row_hash and
    change (see ``upsert``)."""
    first, last = F.struct("first_at", "client_id", "sku"), F.struct("last_at", "client_id", "sku")
    seen = set(records.schema["seen"].dataType.names) if "seen" in records.columns else set()
    by = lambda c: F.struct(f"seen.{c}", "client_id", "sku") if c in seen else last
    incoming = records.groupBy("product_id").agg(
        F.min_by("client_id", F.when(F.col("action") != "merged", first)).alias("client_id"),
        F.min_by("sku", F.when(F.col("action") != "merged", first)).alias("sku"),
        F.max_by("ingest_id", last).alias("ingest_id"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), by(c))).alias(c) for c in UPDATABLE])
    incoming = incoming.withColumn("status", F.lit("active"))
    if base_products is None and at is None:
        return incoming.select(*PRODUCT_COLUMNS)
    out = upsert(base_products, incoming, ["product_id"], [*UPDATABLE, "status"], at, "fill", ["client_id", "sku"], ["ingest_id"])
    return out if at is not None else out.select(*PRODUCT_COLUMNS)


def upsert_crosswalk(records: DataFrame, base: DataFrame | None = None, at: Column | None = None) -> DataFrame:
    """(client_id, src_key) -> product_id, incoming replaces base."""
    inc = records.select("client_id", F.col("sku").alias("src_key"), "product_id")
    if base is None and at is None:
        return inc
    out = upsert(base, inc, ["client_id", "src_key"], ["product_id"], at)
    return out if at is not None else out.select("client_id", "src_key", "product_id")


FEATURE_VALUES = ["value_raw", "unit_raw", "value_normalized", "unit_normalized"]


def upsert_features(features: DataFrame, records: DataFrame, base: DataFrame | None = None, at: Column | None = None) -> DataFrame:
    """Feature values keyed (product_id, etim_feature); the batch's
    last value in order of arrival replaces the stored one."""
    keymap = records.select("client_id", "sku", "product_id")
    inc = (features.join(keymap, ["client_id", "sku"])
           .groupBy("product_id", "etim_feature")
           .agg(*[F.max_by(c, arrival(features, "client_id", "sku", "pos")).alias(c) for c in FEATURE_VALUES]))
    if base is None and at is None:
        return inc
    out = upsert(base, inc, ["product_id", "etim_feature"], FEATURE_VALUES, at)
    return out if at is not None else out.select("product_id", "etim_feature", *FEATURE_VALUES)


def insert_if_absent(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """ON CONFLICT DO NOTHING -- rows whose key exists are dropped."""
    values = [c for c in base.columns if c not in keys]
    return upsert(base, rows, keys, values, how="nothing").select(*base.columns)


def upsert_by_key(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or replace on ``keys`` (file / job records)."""
    values = [c for c in base.columns if c not in keys]
    return upsert(base, rows, keys, values).select(*base.columns)


def import_batch(batch: DataFrame, features: DataFrame, state: dict | None, at: Column) -> tuple[dict, dict[str, int]]:
    """E01-E08 and E12 for one import: (next state, counts).

    ``state`` is what an earlier import returned (products, features,
    crosswalk) or None.  The records are one cut point; products, features
    and crosswalk are written once each, and all counts (created, merged,
    matched, failed; each table's changes) are observed by those writes."""
    state = state or {"products": None, "features": None, "crosswalk": None}
    res = resolve(batch, state["products"], state["crosswalk"])
    records, counts = write_counted(res["records"], "import-records", {a: F.col("action") == a for a in ("created", "merged", "matched")})
    failures, failed = write_counted(res["failures"], "import-failures", {"failed": F.lit(True)})
    tables = {"products": upsert_products(records, state["products"], at), "features": upsert_features(features, records, state["features"], at),
              "crosswalk": upsert_crosswalk(records, state["crosswalk"], at)}
    counts |= failed
    out = {"records": records, "failures": failures}
    for name, df in tables.items():
        out[name], changed = write_counted(df, f"import-{name}", change_counts(name))
        counts |= changed
    return out, counts


def action_counts(records: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Created / merged / matched / failed counts per client."""
    c = records.groupBy("client_id").agg(
        F.count_if(F.col("action") == "created").alias("created"),
        F.count_if(F.col("action") == "merged").alias("merged"),
        F.count_if(F.col("action") == "matched").alias("matched"))
    if failures is None:
        return c
    f = failures.groupBy("client_id").agg(F.count("*").alias("failed"))
    return c.join(f, "client_id", "full").fillna(0)
