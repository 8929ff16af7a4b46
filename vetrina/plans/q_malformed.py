"""Registered queries on real bytes: malformed rows (S07) and refused files
with their encodings (S01-S03).

``part`` is written as 16 supplier files by key.  A quarter of them each has
rows with too many or too few cells, quoted cells with separators and doubled
quotes, cells with a line break, and one quote that never closes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetrina.plans.registry import register
from vetrina.session import scratch_path
from vetrina.sources import files as FS
from vetrina.sources.tables import table

FILES, COLUMNS = 16, ["sku", "name", "brand", "price"]
SEPARATORS = {0: ";", 1: ",", 2: ";", 3: ";"}  # by kind: file number modulo 4

_ROWS = [
    ("f", f"cast(p_partkey % {FILES} as int)"), ("k", f"cast(p_partkey as bigint) {{div}} {FILES}"),
    ("sku", "concat('S-', cast(p_partkey as {vc}))"), ("brand", "p_brand"), ("price", "cast(cast(p_retailprice as decimal(12,2)) as {vc})"), ("plain", "p_name"),
]
_KIND = {"kind": "f % 4", "defect": f"case when f % 4 = 3 and k = 0 then 'open' when f % 4 = 1 and k % 7 = 3 then 'quoted' when f % 4 = 2 and k % 7 = 4 then 'break'"
                                    " when f % 4 <> 2 and k % 7 = 1 then 'long' when f % 4 <> 3 and k % 7 = 2 then 'short' else 'none' end"}


def _cells(cells, **names) -> str:
    return ", ".join(f"{e.format(**names)} as {n}" for n, e in cells.items()) if isinstance(cells, dict) else ", ".join(f"{e.format(**names)} as {n}" for n, e in cells)


def write_files(spark: SparkSession, sf_dir: str) -> str:
    """One text file per file number, lines in the order of the keys."""
    rows = table(spark, sf_dir, "part").where("p_partkey is not null").selectExpr(*[f"{e.format(vc='string', div='div')} as {n}" for n, e in _ROWS])
    rows = rows.selectExpr("*", *[f"{e} as {n}" for n, e in _KIND.items()])
    name = (F.when(F.col("defect") == "quoted", F.concat(F.lit('"'), "plain", F.lit(', ""best"" size"')))
             .when(F.col("defect") == "break", F.concat(F.lit('"'), "plain", F.lit('\nsecond line"')))
             .when(F.col("defect") == "open", F.concat(F.lit('"'), "plain")).otherwise(F.col("plain")))
    joined = lambda *c: F.array_join(F.array(*c), ",")
    semi = lambda *c: F.array_join(F.array(*c), ";")
    full = [F.col("sku"), name, F.col("brand"), F.col("price")]
    by = lambda cells: F.when(F.col("kind") == 1, joined(*cells)).otherwise(semi(*cells))
    line = F.when(F.col("defect") == "short", by(full[:2])).when(F.col("defect") == "long", by([*full, F.lit('"x,y"'), F.lit("more")])).otherwise(by(full))
    heads = spark.range(FILES).select(F.col("id").cast("int").alias("f"), F.lit(-1).cast("long").alias("k"),
                                      F.when(F.col("id") % 4 == 1, ",".join(COLUMNS)).otherwise(";".join(COLUMNS)).alias("value"))
    lines = rows.select("f", "k", line.alias("value")).unionByName(heads)
    path = scratch_path(spark, "malformed")
    lines.repartition("f").sortWithinPartitions("f", "k").select("value", F.col("f").alias("file")).write.partitionBy("file").text(path)
    return path


_BASE = f"""WITH r0 AS (SELECT {_cells(_ROWS, vc='varchar', div='//')} FROM part WHERE p_partkey IS NOT NULL),
r AS (SELECT *, {_cells(_KIND)} FROM r0),
n AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY k) - 1 AS row_num,
        CASE defect WHEN 'quoted' THEN plain || ', "best" size' WHEN 'break' THEN plain || chr(10) || 'second line' WHEN 'open' THEN '"' || plain ELSE plain END AS name FROM r)"""


@register("s07_malformed_rows", f"""{_BASE}
SELECT CASE WHEN kind = 3 THEN 'salvaged' WHEN defect IN ('long', 'short') THEN 'quarantined' ELSE 'good' END AS status, f AS file, row_num, sku, name,
       CASE WHEN defect <> 'short' THEN brand END AS brand, CASE WHEN defect <> 'short' THEN price END AS price,
       CASE WHEN defect <> 'long' THEN '' WHEN kind = 3 THEN '"x,y"|more' ELSE 'x,y|more' END AS overflow,
       CASE WHEN kind = 3 THEN 'quotes never close' WHEN defect = 'long' THEN 'too many cells' WHEN defect = 'short' THEN 'too few cells' END AS reason
FROM n""")
def q_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of each file once, as good, quarantined or salvaged."""
    base = write_files(spark, sf_dir)
    paths = [r.path for r in FS.discover(spark, base, "*.txt").select("path").collect()]
    number = lambda p: int(p.rsplit("/file=", 1)[1].split("/")[0])
    out = None
    for sep in sorted(set(SEPARATORS.values())):
        group = [p for p in paths if SEPARATORS[number(p) % 4] == sep]
        if not group:
            continue
        scan = FS.scan_with_quarantine(spark, group, sep, COLUMNS)
        none = F.array().cast("array<string>")
        for status, reason, overflow in (("good", F.lit(None).cast("string"), none), ("quarantined", F.col("reason"), F.col("overflow")), ("salvaged", F.lit("quotes never close"), F.col("overflow"))):
            rows = scan[status].select(F.lit(status).alias("status"), F.regexp_extract("file_path", r"/file=(\d+)/", 1).cast("int").alias("file"), "row_num", *COLUMNS,
                                       F.array_join(overflow, "|").alias("overflow"), reason.alias("reason"))
            out = rows if out is None else out.unionByName(rows)
    return out


# --------------------------------------------------------------------------
# Files by brand, in several states: admitted, refused, in two encodings.
# --------------------------------------------------------------------------
def write_uploads(spark: SparkSession, sf_dir: str) -> str:
    base = scratch_path(spark, "uploads")
    part = table(spark, sf_dir, "part").where("p_partkey is not null and p_brand is not null")
    brand = F.regexp_replace("p_brand", "#", "_").alias("brand")
    rows = part.select(brand, F.col("p_partkey").alias("k"), F.concat_ws(";", F.col("p_partkey").cast("string"), F.lit("x")).alias("value"))
    brands = part.select(brand).distinct()
    last = lambda text: brands.select("brand", F.lit(1 << 60).alias("k"), F.lit(text).alias("value"))
    put = lambda df, kind, how, **o: getattr(df.repartition("brand").sortWithinPartitions("brand", "k").select("value", "brand").write.partitionBy("brand").options(**o), how)(f"{base}/kind={kind}")
    put(rows, "plain", "text")
    put(rows.unionByName(last("fin é")), "utf8", "text")
    put(rows.unionByName(last("fin é")), "latin", "csv", encoding="ISO-8859-1")
    put(last("  "), "blank", "text")
    put(rows, "oneline", "text", lineSep="|")
    put(rows, "json", "json")
    return base


@register("s01_admission", f"""
WITH p AS (SELECT replace(p_brand, '#', '_') AS brand, p_partkey AS k, concat_ws(';', p_partkey, 'x') AS v FROM part WHERE p_partkey IS NOT NULL AND p_brand IS NOT NULL),
t AS (SELECT brand, string_agg(v || chr(10), '' ORDER BY k) AS body, string_agg(v || '|', '' ORDER BY k) AS bars, string_agg('{{"value":"' || v || '"}}' || chr(10), '' ORDER BY k) AS js FROM p GROUP BY brand),
f AS (SELECT 'plain' AS kind, brand, 'txt' AS ext, encode(body) AS bytes, 'utf-8' AS enc, '' AS err FROM t
      UNION ALL SELECT 'utf8', brand, 'txt', encode(body || 'fin é' || chr(10)), 'utf-8', '' FROM t
      UNION ALL SELECT 'latin', brand, 'csv', encode(body || 'fin ') || '\\xE9'::BLOB || encode(chr(10)), 'iso-8859-1', '' FROM t
      UNION ALL SELECT 'blank', brand, 'txt', encode('  ' || chr(10)), 'utf-8', 'File appears to be empty or contains only whitespace' FROM t
      UNION ALL SELECT 'oneline', brand, 'txt', encode(bars), 'utf-8', 'File must contain at least a header and one data row' FROM t
      UNION ALL SELECT 'json', brand, 'json', encode(js), NULL, 'File extension .json not allowed' FROM t)
SELECT kind, brand, ext AS extension, octet_length(bytes) AS file_size, sha256(bytes) AS content_hash, enc AS encoding, err = '' AS valid, err AS errors FROM f""")
def q_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admitted and refused files with size, hash, encoding and
    errors, from the bytes; the only byte that is not ASCII comes last."""
    files = FS.admission(FS.discover(spark, write_uploads(spark, sf_dir), "part-*"))
    part = lambda n: F.regexp_extract("path", f"/{n}=([^/]*)/", 1).alias(n)
    return files.select(part("kind"), part("brand"), "extension", "file_size", "content_hash", "encoding", "valid", F.array_join("errors", "; ").alias("errors"))
