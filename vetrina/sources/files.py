"""Supplier files: discovery, admission, dialect detection, scans and row
numbering (S01-S08), object keys (P19).

Dialect detection works on lines as rows: a text is exploded into
``(file_id, line_no, line)`` and every statistic is an aggregation per
file, partially aggregated before the shuffle -- a file's lines are never
gathered into one array on one task.  Scans are grouped by dialect so one
``spark.read.csv`` covers every file that shares (separator, encoding,
header).
"""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vetrina.functions.normalize import is_numeric_text, py_strip
from vetrina.session import materialize

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference.
# ---------------------------------------------------------------------------
ALLOWED_EXTENSIONS = ["csv", "tsv", "txt", "xlsx", "xls"]
TEXT_EXTENSIONS = ["csv", "tsv", "txt"]
DELIMITERS = [",", ";", "\t", "|", ":"]
DEFAULT_DELIMITER = ","
HEADER_FIRST_NUMERIC_MAX = 0.3
HEADER_SECOND_NUMERIC_MIN = 0.5


def discover(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files under ``path`` with size and modification time.  The
    ``content`` column is only read when a later step selects it."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path)


def extension(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(name.contains("."), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))).otherwise(F.lit(""))


def utf8_prefix_ok(content: Column, n: int | None = None) -> Column:
    """Are all bytes valid UTF-8, or (``n`` given) the first ``n``?  A
    multi-byte character that the probe cuts is trimmed first."""
    whole = F.is_valid_utf8(content.cast("string"))
    if n is None:
        return whole
    probe = F.substring(content, 1, n)
    trimmed = F.regexp_replace(F.hex(probe), "(?:(?:[C-F][0-9A-F])|(?:[E-F][0-9A-F][89AB][0-9A-F])|"
                                             "(?:F[0-7][89AB][0-9A-F][89AB][0-9A-F]))$", "")
    return F.when(F.octet_length(content) <= n, whole).otherwise(F.is_valid_utf8(F.unhex(trimmed).cast("string")))


def detect_encoding(content: Column, probe_bytes: int | None = None) -> Column:
    """Utf-8 when the whole content decodes, else iso-8859-1 (which
    accepts every byte, so the chain never reaches windows-1252).
    ``probe_bytes=10000`` looks at a prefix only, as the reference does."""
    return F.when(utf8_prefix_ok(content, probe_bytes), F.lit("utf-8")).otherwise(F.lit("iso-8859-1"))


def decode(content: Column, encoding: Column) -> Column:
    """Bytes -> text in the detected encoding; never raises (bytes that are
    not UTF-8 become replacement characters)."""
    return F.when(encoding == "utf-8", F.make_valid_utf8(content.cast("string"))).otherwise(F.decode(content, "ISO-8859-1"))


def admission(files: DataFrame, max_size: int | None = None) -> DataFrame:
    """``valid`` / ``errors`` per file, plus content hash and
    encoding, all from the whole content.  Checks: non-empty, allowed
    extension, for text files non-blank with at least two lines, and the
    size limit if the caller sets one (the reference's is 500 MB)."""
    ext = extension(F.col("path"))
    enc = detect_encoding(F.col("content"))
    text = decode(F.col("content"), enc)
    is_text = ext.isin(*TEXT_EXTENSIONS)
    too_large = F.lit(False) if max_size is None else F.col("length") > max_size
    errors = F.filter(F.array(
        F.when(too_large, F.format_string(f"File size %d exceeds maximum {max_size}", F.col("length"))),
        F.when(F.col("length") == 0, F.lit("File is empty")),
        F.when(~ext.isin(*ALLOWED_EXTENSIONS), F.concat(F.lit("File extension ."), ext, F.lit(" not allowed"))),
        F.when(is_text & (py_strip(text) == ""), F.lit("File appears to be empty or contains only whitespace")),
        F.when(is_text & ~F.contains(text, F.lit("\n")), F.lit("File must contain at least a header and one data row")),
    ), lambda x: x.isNotNull())
    return files.select(
        "path", F.col("length").alias("file_size"), "modificationTime", ext.alias("extension"),
        F.sha2(F.col("content"), 256).alias("content_hash"),
        F.when(is_text, enc).alias("encoding"),
        (F.size(errors) == 0).alias("valid"), errors.alias("errors"))


def text_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A text column -> one row per line: (file_id, line_no, line)."""
    return docs.select(F.col(id_col).alias("file_id"),
                       F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))


def detect_delimiter(lines: DataFrame, sample_lines: int | None = None) -> DataFrame:
    """Per file, the candidate that occurs the same non-zero number of
    times on every non-empty line; the largest such count wins (ties: the
    candidate order , ; tab | :); none -> ','.

    One pass: every line contributes one row per candidate to a
    (file, candidate) aggregation (partially aggregated), whose min / max
    over non-empty lines decide consistency; a file with no usable line
    still appears and gets the default.  ``sample_lines=5`` restricts the
    test to the first five non-empty lines like the reference; the default
    uses every line of the file."""
    ne = py_strip(F.col("line")) != ""
    if sample_lines:
        # The first k non-empty lines by an exact two-stage top-k, so a long
        # file is never ranked in one task; other lines still list the file.
        from vetrina.operators.profile import top_k_per_group
        first = top_k_per_group(lines.filter(ne), ["file_id"], [F.col("line_no")], sample_lines,
                                bucket_key="line_no").select("file_id", "line_no", F.lit(True).alias("__ne"))
        src = lines.join(first, ["file_id", "line_no"], "left").fillna(False, ["__ne"])
    else:
        src = lines.withColumn("__ne", ne)
    counts = [F.struct(F.lit(i).alias("cand"),
                       (F.length("line") - F.length(F.replace(F.col("line"), F.lit(d), F.lit("")))).alias("cnt"))
              for i, d in enumerate(DELIMITERS)]
    per = (src.select("file_id", "__ne", F.explode(F.array(*counts)).alias("c"))
              .groupBy("file_id", F.col("c.cand").alias("cand"))
              .agg(F.min(F.when(F.col("__ne"), F.col("c.cnt"))).alias("lo"),
                   F.max(F.when(F.col("__ne"), F.col("c.cnt"))).alias("hi")))
    ok = (F.col("lo") > 0) & (F.col("lo") == F.col("hi"))
    best = per.groupBy("file_id").agg(F.min(F.when(ok, F.struct((-F.col("lo")).alias("k"), "cand"))).alias("b"))
    cand = F.create_map(*[x for i, d in enumerate(DELIMITERS) for x in (F.lit(i), F.lit(d))])
    return best.select("file_id", F.coalesce(F.element_at(cand, F.col("b.cand")), F.lit(DEFAULT_DELIMITER))
                       .alias("delimiter"))


def detect_header(lines: DataFrame, delimiters: DataFrame) -> DataFrame:
    """Header when fewer than two non-empty lines, when the first two
    rows differ in width, or when the first row is under 30 % numeric while
    the second is over 50 % numeric.  Only the first two non-empty lines of
    each file are ranked (a top-2 per file)."""
    ne = lines.filter(py_strip(F.col("line")) != "")
    # min_by twice gives the first and second non-empty line without a
    # window over the whole file.
    l1 = ne.groupBy("file_id").agg(F.min_by("line", "line_no").alias("l1"), F.min("line_no").alias("n1"),
                                   F.count("*").alias("n_lines"))
    l2 = (ne.join(l1.select("file_id", "n1"), "file_id").filter(F.col("line_no") > F.col("n1"))
            .groupBy("file_id").agg(F.min_by("line", "line_no").alias("l2")))
    j = l1.join(l2, "file_id", "left").join(delimiters, "file_id")
    r1 = F.split(F.col("l1"), F.regexp_replace(F.col("delimiter"), r"([\\^$.|?*+()\[\]{}])", r"\\$1"), -1)
    r2 = F.split(F.col("l2"), F.regexp_replace(F.col("delimiter"), r"([\\^$.|?*+()\[\]{}])", r"\\$1"), -1)
    num = lambda arr: F.size(F.filter(arr, lambda c: is_numeric_text(py_strip(c))))
    header = (F.when(F.col("n_lines") < 2, True)
               .when(F.size(r1) != F.size(r2), True)
               .when((num(r1) / F.size(r1) < HEADER_FIRST_NUMERIC_MAX)
                     & (num(r2) / F.size(r2) > HEADER_SECOND_NUMERIC_MIN), True)
               .otherwise(False))
    return j.select("file_id", "delimiter", header.alias("has_header"),
                    F.when(header, r1).alias("columns"))


def read_delimited(spark: SparkSession, paths: list[str], sep: str, header: bool, encoding: str = "utf-8",
                   schema: str | None = None, multiline: bool = False, escape: str | None = None) -> DataFrame:
    """All-string scan of files sharing one dialect.

    Empty fields stay "" (not null), so mapping can tell empty from absent.
    With a schema, lines that do not fit land in ``_corrupt`` (PERMISSIVE).
    A ``multiline`` file is read by one task, so ask for it only where a
    quoted cell holds a line break (see ``quote_shape``)."""
    r = (spark.read.option("sep", sep).option("header", header).option("encoding", encoding)
         .option("inferSchema", False).option("nullValue", "\u0000").option("emptyValue", "")
         .option("mode", "PERMISSIVE").option("multiLine", multiline))
    if escape is not None:
        r = r.option("escape", escape)
    if schema:
        r = r.schema(schema + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt")
    df = r.csv(paths)
    return df.withColumn("file_path", F.col("_metadata.file_path")) \
             .withColumn("_block", F.col("_metadata.file_block_start"))


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed rows kept whole with their file)."""
    if "_corrupt" not in df.columns:
        return df, df.limit(0)
    bad = F.col("_corrupt").isNotNull()
    # Spark refuses a query of raw CSV that reads only the corrupt column,
    # so the quarantine keeps the parsed fields beside the raw line.
    return df.filter(~bad).drop("_corrupt"), df.filter(bad).withColumnRenamed("_corrupt", "line")


def _quoted(sep: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", sep)


def cells_of(line: Column, sep: str, width: int) -> list[Column]:
    """``col_i`` (null where the row is short) and the ``overflow`` array of
    a split line."""
    return [*[F.get(line, i).alias(f"col_{i}") for i in range(width)],
            F.slice(line, width + 1, F.greatest(F.size(line) - width, F.lit(0))).alias("overflow")]


def salvage_split(spark: SparkSession, paths: list[str], sep: str, width: int) -> DataFrame:
    """S07 fallback: plain text scan split on the separator into ``col_i``
    columns (padded with nulls; the cells of a long row beyond ``width`` are
    the array ``overflow``, else empty) when a file cannot be parsed as CSV at
    all."""
    t = spark.read.text(paths).filter(py_strip(F.col("value")) != "")
    return t.select(*cells_of(F.split(F.col("value"), _quoted(sep), -1), sep, width),
                    F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("_block"))


def quote_shape(spark: SparkSession, paths: list[str], sep: str) -> DataFrame:
    """Files that a line-by-line CSV scan would misread: (file_path, shape).

    A quote counts where it opens or closes a cell; doubled quotes do not.  A
    line with an odd number of them holds a line break inside a cell, or a
    quote that never closes.  ``multiline``: they pair up over the file;
    ``broken``: they do not.  Files without odd lines are not returned.  One
    text scan, one partial row per file and task."""
    q = _quoted(sep)
    marks = F.regexp_count(F.regexp_replace("value", '""', ""), F.lit(f'(?<=^|{q})"|"(?={q}|\\r?$)'))
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file_path"), marks.alias("n"))
    files = lines.groupBy("file_path").agg(F.sum("n").alias("n"), F.max(F.col("n") % 2).alias("odd"))
    return files.where("odd = 1").select("file_path", F.when(F.col("n") % 2 == 0, "multiline").otherwise("broken").alias("shape"))


def scan_with_quarantine(spark: SparkSession, paths: list[str], sep: str, columns: list[str], header: bool = True,
                         encoding: str = "utf-8") -> dict[str, DataFrame]:
    """Every row of the files, good, quarantined or salvaged.

    * ``good``: file_path, row_num and the columns;
    * ``quarantined``: rows with too many or too few cells: the raw ``line``,
      its cells as far as they go (``overflow`` holds the rest) and a reason;
    * ``salvaged``: the lines of files whose quotes never close, split plainly.

    Files without line breaks in cells are scanned by splits; the few others
    are named by ``quote_shape`` (one row each reaches the driver, which holds
    the list of files anyway).  Row numbers count the records of a file from
    0, good or not.  The scan is written once, as both sides read it.  A group
    without files gives an empty frame with the same columns."""
    place = lambda p: re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", p)
    odd = {place(unquote(r.file_path)): r.shape for r in quote_shape(spark, paths, sep).collect()}  # _metadata has URIs
    shape = {p: odd.get(place(p), "plain") for p in paths}
    schema = ", ".join(f"`{c}` string" for c in columns)
    scans = []
    for kind in ("plain", "multiline"):
        group = [p for p in paths if shape[p] == kind]
        if group:
            scans.append(number_rows(read_delimited(spark, group, sep, header, encoding, schema, kind == "multiline", '"')))
    if scans:
        rows = materialize(reduce(DataFrame.unionByName, scans).drop("_block"), "scanned")
    else:
        rows = spark.createDataFrame([], f"{schema}, _corrupt string, file_path string, row_num long")
    good, bad = quarantine(rows)
    cut = F.transform(F.split("line", f'{_quoted(sep)}(?=(?:[^"]*"[^"]*")*[^"]*$)', -1),
                      lambda c: F.when(c.rlike('(?s)^".*"$'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    n = len(columns)
    reason = F.when(F.size("cells") > n, "too many cells").when(F.size("cells") < n, "too few cells").otherwise("not a row")
    bad = bad.select("file_path", "row_num", "line").withColumn("cells", cut)
    named = [F.col(f"col_{i}").alias(c) for i, c in enumerate(columns)]
    quarantined = bad.select("file_path", "row_num", "line", reason.alias("reason"), *cells_of(F.col("cells"), sep, n)).select(
        "file_path", "row_num", "line", "reason", *named, "overflow")
    broken = [p for p in paths if shape[p] == "broken"]
    if broken:
        lines = number_rows(salvage_split(spark, broken, sep, n))
        if header:
            lines = lines.where("row_num > 0").withColumn("row_num", F.col("row_num") - 1)
        salvaged = lines.select("file_path", "row_num", *named, "overflow")
    else:
        salvaged = spark.createDataFrame([], f"file_path string, row_num long, {schema}, overflow array<string>")
    return {"good": good.select("file_path", "row_num", *columns), "quarantined": quarantined, "salvaged": salvaged}


def number_rows(df: DataFrame) -> DataFrame:
    """0-based ordinal of each record within its file, distributed.

    Rows of one (file, split) are contiguous inside one Spark partition, so
    ``monotonically_increasing_id`` minus the chunk's minimum is the
    position inside the chunk; the chunk's offset is the row count of the
    file's earlier splits (a window over chunks, one row per split, never
    over rows)."""
    m = df.withColumn("__mid", F.monotonically_increasing_id())
    chunks = m.groupBy("file_path", "_block").agg(F.min("__mid").alias("__min"), F.count("*").alias("__n"))
    w = Window.partitionBy("file_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("__off", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    # One row per split: small, so AQE broadcasts it when it fits.
    return (m.join(chunks.select("file_path", "_block", "__min", "__off"), ["file_path", "_block"])
            .withColumn("row_num", F.col("__off") + F.col("__mid") - F.col("__min"))
            .drop("__mid", "__min", "__off"))


def object_key(uri: Column) -> Column:
    """``s3://bucket/key`` -> key (null when not an s3 URI)."""
    return F.when(uri.startswith("s3://") & F.substring(uri, 6, 1 << 30).contains("/"),
                  F.regexp_extract(uri, r"^s3://[^/]*/(.*)$", 1))


def clean_filename(name: Column) -> Column:
    """Keep letters, digits and ``.-_``."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}._-]", "")


def storage_key(client: Column, ingest: Column, filename: Column, at: Column, prefix: str = "uploads") -> Column:
    """``prefix/client/yyyy/MM/dd/ingest/clean_name``."""
    return F.concat_ws("/", F.lit(prefix), client, F.date_format(at, "yyyy/MM/dd"), ingest,
                       clean_filename(filename))
