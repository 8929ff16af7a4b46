"""Registered queries: file sources and column-name suggestions (S02-S10,
P12-P14, P19, F14, F16, F17).

Documents stand for uploaded text files: every line of every document is
used (delimiter consistency, header rule); the first non-empty line is
the header row the suggestion operators read.  The CSV round trip writes
``raw_product`` as two supplier files (two separators, two encodings) and
runs discovery, detection, the grouped scan and row numbering on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vetrina.functions import records as REC
from vetrina.functions.normalize import NUMBER_RE
from vetrina.operators import suggest as SG
from vetrina.plans.fixtures import RAW_PRODUCT_COLUMNS, raw_product, raw_product_sql
from vetrina.plans.q_normalize import sql_text
from vetrina.plans.registry import register
from vetrina.plans.sqlfrag import missing, strip
from vetrina.session import scratch_path
from vetrina.sources import files as FS
from vetrina.sources import staging as ST
from vetrina.sources.tables import table

DEMO_SOURCE_COLUMNS = ["SKU", "Name", "Brand", "GTIN", "Length", "Length_Unit", "Diameter",
                       "Diameter_Unit", "Material"]


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FS.text_lines(table(spark, sf_dir, "documents"), "doc_id", "text")


def header_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, ordinal, column_name) from each document's header row."""
    lines = doc_lines(spark, sf_dir)
    h = FS.detect_header(lines, FS.detect_delimiter(lines)).filter("has_header")
    return h.select("file_id", F.posexplode("columns").alias("ordinal", "column_name"))


# --------------------------------------------------------------------------
@register("s02_s03_hash_encoding", """
SELECT doc_id, sha256(text) AS content_hash, 'utf-8' AS encoding, CAST(strlen(text) AS BIGINT) AS n_bytes
FROM documents""")
def q_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of the bytes and the encoding (whole text)."""
    d = table(spark, sf_dir, "documents")
    b = F.encode("text", "UTF-8")
    return d.select("doc_id", F.sha2(b, 256).alias("content_hash"),
                    FS.detect_encoding(b, None).alias("encoding"),
                    F.octet_length(b).cast("bigint").alias("n_bytes"))


_LINES_SQL = """lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents),
ne AS (SELECT * FROM lines WHERE """ + strip("line") + """ <> '')"""
_CANDS = "[',', ';', chr(9), '|', ':']"
DELIM_SQL = f"""{_LINES_SQL},
cc AS (SELECT doc_id, unnest(range(5)) AS cand,
              unnest(list_transform({_CANDS}, lambda d: length(line) - length(replace(line, d, '')))) AS cnt
       FROM ne),
per AS (SELECT doc_id, cand, min(cnt) AS lo, max(cnt) AS hi FROM cc GROUP BY ALL),
best AS (SELECT doc_id, arg_min(cand, (-lo, cand)) AS cand FROM per WHERE lo > 0 AND lo = hi GROUP BY doc_id),
delim AS (SELECT d.doc_id, coalesce({_CANDS}[best.cand + 1], ',') AS delimiter
          FROM (SELECT DISTINCT doc_id FROM lines) d LEFT JOIN best ON d.doc_id = best.doc_id)"""


@register("s04_delimiter", f"""WITH {DELIM_SQL}
SELECT doc_id AS file_id, delimiter FROM delim""")
def q_delimiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimiter with equal non-zero counts on every non-empty line."""
    return FS.detect_delimiter(doc_lines(spark, sf_dir))


def _num_cells(arr: str) -> str:
    s = strip(f"replace(c, ',', '')")
    return f"len(list_filter({arr}, lambda c: regexp_full_match({s}, '{NUMBER_RE[1:-1]}')))"


HEADER_SQL = f"""{DELIM_SQL},
l1 AS (SELECT doc_id, arg_min(line, line_no) AS l1, min(line_no) AS n1, count(*) AS n_lines FROM ne GROUP BY doc_id),
l2 AS (SELECT ne.doc_id, arg_min(ne.line, ne.line_no) AS l2 FROM ne JOIN l1 ON ne.doc_id = l1.doc_id
       WHERE ne.line_no > l1.n1 GROUP BY ne.doc_id),
h AS (SELECT l1.doc_id, delim.delimiter, l1.n_lines, string_split(l1.l1, delim.delimiter) AS r1,
             string_split(l2.l2, delim.delimiter) AS r2
      FROM l1 LEFT JOIN l2 ON l1.doc_id = l2.doc_id JOIN delim ON delim.doc_id = l1.doc_id),
hh AS (SELECT *, CASE WHEN n_lines < 2 THEN TRUE WHEN len(r1) <> len(r2) THEN TRUE
         WHEN {_num_cells('r1')} / CAST(len(r1) AS DOUBLE) < 0.3 AND {_num_cells('r2')} / CAST(len(r2) AS DOUBLE) > 0.5
         THEN TRUE ELSE FALSE END AS has_header FROM h)"""


@register("s05_header", f"""WITH {HEADER_SQL}
SELECT doc_id AS file_id, delimiter, has_header, CASE WHEN has_header THEN len(r1) END AS n_columns FROM hh""")
def q_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header rule on the first two non-empty lines of each text."""
    lines = doc_lines(spark, sf_dir)
    h = FS.detect_header(lines, FS.detect_delimiter(lines))
    return h.select("file_id", "delimiter", "has_header", F.size("columns").cast("bigint").alias("n_columns"))


COLS_SQL = f"""{HEADER_SQL},
cols AS (SELECT doc_id AS file_id, unnest(range(len(r1))) AS ordinal, unnest(r1) AS column_name
         FROM hh WHERE has_header)"""
_RULES = ", ".join(f"({p}, '{k}', '{kind}', '{t}', CAST({c} AS DOUBLE))" for p, k, kind, t, c in
                   SG.NAME_RULES + SG.EXTRA_NAME_RULES)


@register("p12_column_suggestions", f"""WITH {COLS_SQL},
rules(priority, keyword, kind, target, confidence) AS (VALUES {_RULES}),
hits AS (SELECT c.*, r.* FROM cols c JOIN rules r
         ON contains(lower(trim(c.column_name)), r.keyword)
         AND NOT (r.kind = 'feature' AND (contains(lower(trim(c.column_name)), 'unit')
              OR contains(lower(trim(c.column_name)), 'einheit') OR contains(lower(trim(c.column_name)), 'uom'))))
SELECT file_id, ordinal, column_name, arg_min(kind, priority) AS kind, arg_min(target, priority) AS target,
       arg_min(confidence, priority) AS confidence
FROM hits GROUP BY file_id, ordinal, column_name""")
def q_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First matching name rule per header column."""
    return SG.suggest_targets(header_columns(spark, sf_dir), SG.name_rules_df(spark)).withColumn(
        "ordinal", F.col("ordinal").cast("bigint"))


def _base_sql(x: str) -> str:
    out = f"lower({x})"
    for suf in SG.VALUE_SUFFIXES:
        out = f"replace({out}, '{suf}', '')"
    return out


@register("p13_unit_pairs", f"""WITH {COLS_SQL},
pairs AS (SELECT a.file_id, a.ordinal AS v_ord, a.column_name AS value_column, b.ordinal AS u_ord,
                 b.column_name AS unit_column
          FROM cols a JOIN cols b ON a.file_id = b.file_id
          WHERE a.column_name <> b.column_name
            AND (contains(lower(b.column_name), 'unit') OR contains(lower(b.column_name), 'einheit')
                 OR contains(lower(b.column_name), 'uom'))
            AND (contains(lower(b.column_name), {_base_sql('a.column_name')})
                 OR len(list_filter(string_split({_base_sql('a.column_name')}, '_'),
                                    lambda p: contains(lower(b.column_name), p))) > 0))
SELECT file_id, v_ord, value_column, arg_min(unit_column, u_ord) AS unit_column FROM pairs GROUP BY ALL""")
def q_unit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value column -> its unit column within each file."""
    return SG.pair_unit_columns(header_columns(spark, sf_dir)).withColumn("v_ord", F.col("v_ord").cast("bigint"))


_EXPECTED = ", ".join(f"({i}, '{c}')" for i, c in enumerate(DEMO_SOURCE_COLUMNS))


@register("p14_template_adaptation", f"""WITH {COLS_SQL},
expected(e_ord, expected) AS (VALUES {_EXPECTED}),
m AS (SELECT c.file_id, e.e_ord, e.expected, c.column_name AS actual, c.ordinal AS a_ord,
             CASE WHEN lower(e.expected) = lower(c.column_name) THEN 1.0
                  WHEN contains(lower(c.column_name), lower(e.expected))
                    OR contains(lower(e.expected), lower(c.column_name)) THEN 0.8 END AS score
      FROM cols c JOIN expected e ON lower(e.expected) = lower(c.column_name)
        OR contains(lower(c.column_name), lower(e.expected)) OR contains(lower(e.expected), lower(c.column_name)))
SELECT file_id, e_ord, expected, arg_min(actual, (-score, a_ord)) AS actual,
       CAST(max(score) AS DOUBLE) AS score
FROM m WHERE score IS NOT NULL GROUP BY ALL""")
def q_adapt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The demo template's expected columns matched to each file's
    header (equal 1.0, containment 0.8, first column wins).  The expected
    side is the template's handful of names, broadcast per file."""
    exp = spark.createDataFrame(list(enumerate(DEMO_SOURCE_COLUMNS)), "ordinal int, column_name string")
    return SG.adapt_template(exp, header_columns(spark, sf_dir))


# --------------------------------------------------------------------------
@register("p19_object_keys", r"""
WITH u AS (SELECT page_id, regexp_replace(url, '^https?://', 's3://') AS uri FROM pages),
k AS (SELECT page_id, uri, CASE WHEN starts_with(uri, 's3://') AND contains(substr(uri, 6), '/')
                               THEN regexp_extract(uri, '^s3://[^/]*/(.*)$', 1) END AS object_key FROM u)
SELECT page_id, object_key,
  'uploads/pages/2024/01/31/' || CAST(page_id AS VARCHAR) || '/' ||
    regexp_replace(regexp_extract(object_key, '([^/]*)$', 1), '[^\p{L}\p{N}._-]', '', 'g') AS storage_key
FROM k""")
def q_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object key from an s3 URI and the cleaned, dated storage key."""
    p = table(spark, sf_dir, "pages")
    uri = F.regexp_replace("url", "^https?://", "s3://")
    key = FS.object_key(uri)
    return p.select("page_id", key.alias("object_key"),
                    FS.storage_key(F.lit("pages"), F.col("page_id").cast("string"),
                                   F.regexp_extract(key, r"([^/]*)$", 1),
                                   F.lit("2024-01-31").cast("date")).alias("storage_key"))


@register("f14_duplicate_rows", """
SELECT sha256(json_object('text', text)) AS row_hash, count(*) AS n_copies, min(doc_id) AS first_doc
FROM documents GROUP BY 1 HAVING count(*) > 1""")
def q_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exact duplicate rows by content hash (one group per copy set)."""
    d = table(spark, sf_dir, "documents")
    return (d.groupBy(REC.row_hash("text").alias("row_hash"))
            .agg(F.count("*").alias("n_copies"), F.min("doc_id").alias("first_doc"))
            .filter(F.col("n_copies") > 1))


_PROGRESS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in REC.STAGE_PROGRESS.items())


@register("f16_job_progress", f"""
WITH j AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'completed'
             WHEN 'O' THEN 'normalizing' ELSE 'mapped' END AS status FROM orders)
SELECT job_id, status, CAST(CASE status {_PROGRESS} ELSE 0 END AS INTEGER) AS percent,
  CASE status WHEN 'completed' THEN 'profiling,mapping,validation,normalization,execution,completion'
              WHEN 'normalizing' THEN 'profiling,mapping,validation' WHEN 'mapped' THEN 'profiling,mapping'
              ELSE '' END AS completed_stages
FROM j""")
def q_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: job status -> percent and completed stages."""
    o = table(spark, sf_dir, "orders")
    st = (F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "normalizing")
           .otherwise("mapped"))
    j = o.select(F.col("o_orderkey").alias("job_id"), st.alias("status"))
    return j.select("job_id", "status", REC.progress_percent("status").cast("int").alias("percent"),
                    F.array_join(REC.completed_stages("status"), ",").alias("completed_stages"))


@register("f17_json_access", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k_typed,
       json_extract_string(props, '$.k') AS k_variant, json_extract_string(props, '$.k') AS k_path
FROM events""")
def q_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a JSON field three ways: typed ``from_json``, variant, path."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", REC.json_field("props", "$.k", "k int").alias("k_typed"),
                    REC.json_field("props", "$.k").alias("k_variant"),
                    F.get_json_object("props", "$.k").alias("k_path"))


# --------------------------------------------------------------------------
# CSV round trip: raw_product -> two supplier files -> detect -> scan -> number.
# --------------------------------------------------------------------------
SUPPLIER_PARTS = 4
DIALECTS = {"c0": (";", "UTF-8"), "c1": (",", "ISO-8859-1")}


def write_supplier_files(spark: SparkSession, sf_dir: str) -> str:
    base = scratch_path(spark, "supplier-csv")
    raw = raw_product(spark, sf_dir)
    for client, (sep, enc) in DIALECTS.items():
        # several part files in the order of the rows
        (raw.filter(F.col("client_id") == client).repartitionByRange(SUPPLIER_PARTS, "row_num")
         .sortWithinPartitions("row_num").select(*RAW_PRODUCT_COLUMNS).write.option("header", True).option("sep", sep).option("encoding", enc)
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
         .csv(f"{base}/{client}"))
    return base


def scan_supplier_files(spark: SparkSession, base: str) -> tuple[DataFrame | None, DataFrame]:
    """S01 admission -> S03 encoding -> S04 delimiter -> S06 grouped scan
    -> S08 numbering.  The dialect table is one row per file (metadata).
    (rows, refused files with their errors); no rows if all are refused."""
    admitted = FS.admission(FS.discover(spark, base, "*.csv"))
    refused, files = admitted.filter("not valid").select("path", "errors"), admitted.filter("valid")
    text = spark.read.text(base + "/*/*.csv").select(F.col("_metadata.file_path").alias("file_id"),
                                                     F.col("value").alias("line"))
    lines = text.withColumn("line_no", F.lit(0))
    delim = FS.detect_delimiter(lines)
    dialects = (files.join(delim, files["path"] == delim["file_id"])
                .select("path", "delimiter", "encoding").collect())
    groups: dict[tuple, list[str]] = {}
    for r in dialects:
        groups.setdefault((r["delimiter"], r["encoding"]), []).append(r["path"])
    out = None
    for (sep, enc), paths in sorted(groups.items()):
        df = FS.number_rows(FS.read_delimited(spark, paths, sep, True, enc))
        client = F.regexp_extract("file_path", r"/(c\d+)/", 1).alias("client_id")
        df = df.select(client, "file_path", "row_num", *RAW_PRODUCT_COLUMNS)
        out = df if out is None else out.unionByName(df)
    if out is None:
        return None, refused
    # a client's rows go on counting from file to file (one row per file here)
    counts = out.groupBy("client_id", "file_path").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("client_id").orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select("client_id", "file_path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return (out.join(start, ["client_id", "file_path"])
            .withColumn("row_num", F.col("row_num") + F.col("start")).drop("start", "file_path")), refused


@register("s06_s08_csv_roundtrip", f"""WITH {raw_product_sql()}
SELECT client_id, CAST(row_number() OVER (PARTITION BY client_id ORDER BY row_num) - 1 AS BIGINT) AS row_num,
  "SKU", "GTIN", "Length", "Price", "Currency"
FROM raw_product""")
def q_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier files in two dialects are admitted,
    their dialect detected, scanned per dialect group and row-numbered."""
    df, _ = scan_supplier_files(spark, write_supplier_files(spark, sf_dir))
    return df.select("client_id", "row_num", "SKU", "GTIN", "Length", "Price", "Currency")


@register("s09_s10_staging", f"""WITH {raw_product_sql()}
SELECT row_num, CASE WHEN {missing('"SKU"')} THEN NULL ELSE upper({sql_text(strip('"SKU"'))}) END AS sku,
       "Name" AS name
FROM raw_product WHERE client_id = 'c0' AND ingest_id = 'ing-0'""")
def q_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S10 write + dynamic upsert of one ingest partition, S09 pruned read."""
    from vetrina.functions.normalize import normalize_text
    path = scratch_path(spark, "staging")
    raw = raw_product(spark, sf_dir).select("client_id", "ingest_id", "row_num", "SKU", "Name")
    ST.write_staging(raw.withColumn("sku", F.col("SKU")), path)
    one = ST.read_staging(spark, path, "c0", "ing-0")
    fixed = one.withColumn("sku", F.when(F.col("SKU").isNull() | (F.col("SKU") == ""), F.lit(None))
                           .otherwise(normalize_text("SKU", case="upper")))
    # Never read and overwrite one path in one plan: the new partition is
    # first written to its own folder, then swapped in.
    tmp = scratch_path(spark, "staging-update")
    fixed.write.parquet(tmp)
    ST.upsert_staging(spark.read.parquet(tmp), path)
    return ST.read_staging(spark, path, "c0", "ing-0").select("row_num", "sku", F.col("Name").alias("name"))


_RULES_COMPAT = ", ".join(f"({p}, '{k}', '{kind}', '{t}', CAST({c} AS DOUBLE))" for p, k, kind, t, c in SG.NAME_RULES)


@register("p12_column_suggestions_compat", f"""WITH {COLS_SQL},
rules(priority, keyword, kind, target, confidence) AS (VALUES {_RULES_COMPAT}),
hits AS (SELECT c.*, r.* FROM cols c JOIN rules r ON contains(lower(trim(c.column_name)), r.keyword))
SELECT file_id, ordinal, column_name, arg_min(kind, priority) AS kind, arg_min(target, priority) AS target,
       arg_min(confidence, priority) AS confidence
FROM hits GROUP BY file_id, ordinal, column_name""")
def q_suggest_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12 with the reference's semantics: no ``artikel`` rule, unit columns
    offered to feature rules too (SURVEY 3.5 #15, #16)."""
    return SG.suggest_targets(header_columns(spark, sf_dir), SG.name_rules_df(spark, compat=True),
                              compat=True).withColumn("ordinal", F.col("ordinal").cast("bigint"))
