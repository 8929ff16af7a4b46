"""Template mapping.

A mapping template is small metadata: a list of field mappings (source
column -> product column) and feature mappings (source column -> ETIM
feature with an optional unit column).  The driver compiles it once into
Spark ``Column`` expressions and applies it to the raw rows in a single
``select``: no UDF, no per-row Python, no shuffle.

Row contract (per mapping, as in the reference):

* source null or "" -> an issue if the mapping is required, else the
  default value; a null result leaves the target absent (null here);
* two field mappings on one target: the later non-null value wins;
* a feature with a missing source is left out of ``features``.

Output columns: the key columns, ``product`` (struct of product columns),
``features`` (array of structs) and ``issues`` (array of mapping errors).
"""

from __future__ import annotations

import ast
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession

from pyspark.sql import functions as F
from pyspark.sql import types as T

from vetrina.functions.normalize import is_missing, py_strip, python_float
from vetrina.functions.records import spread_null

# Canonical product columns (the union of what the DDL and the code use).
PRODUCT_FIELDS = ["sku", "gtin", "product_name", "brand", "model", "description",
                  "etim_class", "price", "list_price", "cost_price", "currency",
                  "length", "width", "height", "diameter", "weight"]

FEATURE_TYPE = T.StructType([
    T.StructField("etim_feature", T.StringType()),
    T.StructField("value_raw", T.StringType()),
    T.StructField("unit_raw", T.StringType()),
    T.StructField("value_transformed", T.StringType()),
    T.StructField("source_column", T.StringType()),
])
ISSUE_TYPE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("field", T.StringType()),
    T.StructField("error", T.StringType()),
])

TRANSFORM_TYPES = ("direct", "lookup", "formula", "concat", "split", "regex", "uom_convert")


@dataclass(frozen=True)
class FieldMapping:
    src_column: str
    target_column: str
    transform_type: str = "direct"
    transform_config: dict = field(default_factory=dict, hash=False, compare=False)
    is_required: bool = False
    default_value: str | None = None


@dataclass(frozen=True)
class FeatureMapping:
    src_column: str
    etim_feature: str
    unit_column: str | None = None
    transform_type: str = "direct"
    transform_config: dict = field(default_factory=dict, hash=False, compare=False)
    is_required: bool = False


@dataclass
class Template:
    field_mappings: list[FieldMapping]
    feature_mappings: list[FeatureMapping]
    template_id: str | None = None
    client_id: str | None = None
    name: str | None = None
    version: int = 1


def demo_template() -> Template:
    """The seeded demo fastener template."""
    return Template(
        field_mappings=[
            FieldMapping("SKU", "sku", is_required=True),
            FieldMapping("Name", "product_name"),
            FieldMapping("Brand", "brand"),
            FieldMapping("GTIN", "gtin"),
        ],
        feature_mappings=[
            FeatureMapping("Length", "EF001001", "Length_Unit"),
            FeatureMapping("Diameter", "EF001002", "Diameter_Unit"),
            FeatureMapping("Material", "EF001003"),
        ],
        template_id="tmpl-demo", client_id="demo", name="Demo Fastener Template", version=1)


def catalogue_template() -> Template:
    """Demo template plus price and currency, for files that carry them."""
    t = demo_template()
    return Template(
        field_mappings=t.field_mappings + [FieldMapping("Price", "price"),
                                           FieldMapping("Currency", "currency")],
        feature_mappings=t.feature_mappings, template_id="tmpl-catalogue",
        client_id="global", name="Catalogue template", version=1)


# ---------------------------------------------------------------------------
# Transforms: each returns (value Column, error Column or None).  The error
# column is a message string when the transform raised in the reference.
# ---------------------------------------------------------------------------

def _src(df_cols: set[str], name: str | None) -> Column:
    return F.col(f"`{name}`") if name and name in df_cols else F.lit(None).cast("string")


def t_direct(v: Column, cfg: dict, cols: set[str]):
    """Strip; optional strip of quote characters; optional case."""
    out = py_strip(v)
    if cfg.get("remove_quotes"):
        out = F.regexp_replace(out, "^[\"']+|[\"']+$", "")
    if cfg.get("uppercase"):
        out = F.upper(out)
    elif cfg.get("lowercase"):
        out = F.lower(out)
    return out, None


def t_lookup(v: Column, cfg: dict, cols: set[str]):
    """Exact key, then first case-insensitive key, then the default,
    else the original value.  The table is a literal map for small tables;
    a ``lookup_ref`` names a large one, which is joined (``lookup_join``)."""
    table = {str(k): (None if x is None else str(x)) for k, x in (cfg.get("lookup_table") or {}).items()}
    key = py_strip(v)
    lowered: dict[str, str | None] = {}
    for k, x in table.items():
        lowered.setdefault(k.lower(), x)
    exact = F.create_map(*[F.lit(y) for kv in table.items() for y in kv]) if table else None
    ci = F.create_map(*[F.lit(y) for kv in lowered.items() for y in kv]) if table else None
    fallback = F.lit(str(cfg["default_value"])) if cfg.get("default_value") is not None else v
    if not table:
        return fallback, None
    hit_exact = F.map_contains_key(exact, key)
    hit_ci = F.map_contains_key(ci, F.lower(key))
    out = (F.when(hit_exact, F.element_at(exact, key))
            .when(hit_ci, F.element_at(ci, F.lower(key)))
            .otherwise(fallback))
    return out, None


def lookup_join(df: DataFrame, column: str, table: DataFrame, out: str,
                default_value: str | None = None) -> DataFrame:
    """P04 for large lookup tables (``table``: key, value, ordinal).

    One left join on the lower-cased stripped key: the table is aggregated to
    one row per such key, with the spellings it has and the value of the
    first, so no row is multiplied and the facts are shuffled once at most
    (Spark's byte threshold decides on a broadcast, AQE splits hot keys).  The
    first entry by ``ordinal`` wins; null keys on either side match nothing."""
    by_key = table.where(F.col("key").isNotNull()).groupBy("key").agg(F.min(F.struct("ordinal", "value")).alias("e"))
    by_lower = (by_key.groupBy(F.lower("key").alias("__low"))
                .agg(F.map_from_entries(F.collect_list(F.struct("key", F.col("e.value").alias("v")))).alias("__exact"), F.min("e")["value"].alias("__first")))
    keyed = df.withColumn("__key", py_strip(F.col(f"`{column}`")))
    j = keyed.withColumn("__join", spread_null(F.lower("__key"))).join(by_lower, F.col("__join") == F.col("__low"), "left")
    fallback = F.lit(default_value) if default_value is not None else F.col(f"`{column}`")
    res = (F.when(F.map_contains_key("__exact", F.col("__key")), F.element_at("__exact", F.col("__key")))
            .when(F.col("__low").isNotNull(), F.col("__first")).otherwise(fallback))
    return j.withColumn(out, res).drop("__key", "__join", "__low", "__exact", "__first")


_FORMULA_TEXT = re.compile(r"^[\d\+\-\*\/\.\(\)\s]+$")
_PLACEHOLDER = re.compile(r"\{([^{}]+)\}")


_INT_TEXT = r"^\s*[+-]?[0-9]+\s*$"


def _formula_column(formula: str, cols: set[str], value: Column):
    """Compile an arithmetic formula with ``{value}`` / ``{column}`` slots.

    Python's own parser reads the formula once on the driver; each slot
    becomes ``float(column)``.  Alongside the value, a boolean column says
    whether Python would produce an int (int operands, no true division),
    so the text result prints like Python's.  Returns (value, is_int,
    [slot columns]) or None when no row could pass the whitelist."""
    slots: dict[str, str] = {}

    def repl(m):
        name = m.group(1)
        if name != "value" and name not in cols:
            return m.group(0)          # left in place -> whitelist fails
        ident = f"__s{len(slots)}"
        slots.setdefault(name, ident)
        return f" {slots[name]} "
    text = _PLACEHOLDER.sub(repl, formula)
    skeleton = re.sub(r"__s\d+", "1", text)
    if not _FORMULA_TEXT.match(skeleton):
        return None
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except SyntaxError:
        return None
    slot_cols = {ident: (value if name == "value" else F.col(f"`{name}`"))
                 for name, ident in slots.items()}

    def build(node):
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return F.lit(float(node.value)), F.lit(isinstance(node.value, int))
        if isinstance(node, ast.Name) and node.id in slot_cols:
            c = slot_cols[node.id]
            return python_float(c), c.rlike(_INT_TEXT)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            x, xi = build(node.operand)
            return (-x if isinstance(node.op, ast.USub) else x), xi
        if isinstance(node, ast.BinOp):
            (a, ai), (b, bi) = build(node.left), build(node.right)
            op = node.op
            if isinstance(op, ast.Add):
                return a + b, ai & bi
            if isinstance(op, ast.Sub):
                return a - b, ai & bi
            if isinstance(op, ast.Mult):
                return a * b, ai & bi
            if isinstance(op, ast.Div):
                return F.try_divide(a, b), F.lit(False)
            if isinstance(op, ast.FloorDiv):
                return F.floor(F.try_divide(a, b)).cast("double"), ai & bi
            if isinstance(op, ast.Pow):
                return F.pow(a, b), ai & bi & (b >= 0)
        raise ValueError("unsupported formula")
    try:
        expr, is_int = build(tree)
        return expr, is_int, list(slot_cols.values())
    except ValueError:
        return None


def t_formula(v: Column, cfg: dict, cols: set[str]):
    """Evaluate a whitelisted arithmetic formula, else the original.

    A slot whose text is not a plain number makes the row keep its
    original value (the reference would string-substitute and ``eval``;
    only plain numbers are evaluated here).  An int result prints as an
    int, a float as Spark's double text (the same as Python's below 1e7).
    """
    formula = cfg.get("formula") or ""
    if not formula:
        return v, None
    compiled = _formula_column(formula, cols, v)
    if compiled is None:
        return v, None
    expr, is_int, slots = compiled
    ok = F.lit(True)
    for s in slots:
        ok = ok & python_float(s).isNotNull()
    # an integer beyond 64 bits stays a plain number; it must not end the job
    whole = F.coalesce(expr.try_cast("bigint").cast("string"), expr.try_cast("decimal(38,0)").cast("string"), expr.cast("string"))
    as_text = F.when(is_int, whole).otherwise(expr.cast("string"))
    return F.when(ok & expr.isNotNull(), as_text).otherwise(v), None


def t_concat(v: Column, cfg: dict, cols: set[str]):
    """Value + non-empty other columns joined by a separator."""
    sep = cfg.get("separator", " ")
    parts = [v] + [F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`"))
                   for c in cfg.get("columns", []) if c in cols]
    return F.concat_ws(sep, *parts), None


def t_split(v: Column, cfg: dict, cols: set[str]):
    """Part ``index`` of the split, stripped; out of range -> value."""
    sep = cfg.get("separator", " ")
    idx = int(cfg.get("index", 0))
    if idx < 0:
        return v, None
    part = F.get(F.split(v, re.escape(sep), -1), F.lit(idx))
    return F.coalesce(py_strip(part), v), None


def t_regex(v: Column, cfg: dict, cols: set[str]):
    """Regex substitution; a pattern Python rejects keeps the value."""
    pattern = cfg.get("pattern", "")
    if not pattern:
        return v, None
    try:
        re.compile(pattern)
    except re.error:
        return v, None
    repl = cfg.get("replacement", "")
    # Python group refs \1 / \g<1> -> Java $1; a literal $ must be escaped.
    repl = repl.replace("$", r"\$")
    repl = re.sub(r"\\g<(\d+)>", r"$\1", repl)
    repl = re.sub(r"\\(\d+)", r"$\1", repl)
    return F.regexp_replace(v, pattern, repl), None


def t_uom_convert(v: Column, cfg: dict, cols: set[str], factor=None, offset=None):
    """``float(value) * factor + offset`` for the configured pair.

    Non-numeric text raises in the reference: here it yields an error
    message and a null value.  The factor is resolved beforehand from the
    unit table (one pair per mapping, a constant)."""
    num = python_float(v)
    err = F.when(num.isNull(), F.concat(F.lit("could not convert string to float: '"), v, F.lit("'")))
    if factor is None:
        out = num
    else:
        out = num * F.lit(float(factor)) + F.lit(float(offset or 0))
    return out.cast("string"), err


TRANSFORMS = {
    "direct": t_direct, "lookup": t_lookup, "formula": t_formula, "concat": t_concat,
    "split": t_split, "regex": t_regex,
}


def register_transform(name: str, fn) -> None:
    """Extension point: ``fn(value_col, config, columns) -> (Column, error)``."""
    TRANSFORMS[name] = fn


def _resolve_uom_pairs(spark: SparkSession, uom: DataFrame | None, pairs: set) -> dict:
    """Fetch factors for the (from, to) pairs named in a template.

    A template names a handful of pairs; the table is filtered to them and
    aggregated to one row per pair, so only those rows reach the driver.
    Inactive rows are ignored; of several, the smallest factor counts."""
    if not pairs or uom is None:
        return {}
    cond = F.lit(False)
    for a, b in pairs:
        cond = cond | ((F.col("source_unit") == a) & (F.col("target_unit") == b))
    if "is_active" in uom.columns:
        cond = cond & F.coalesce(F.col("is_active"), F.lit(True))
    rows = (uom.filter(cond & F.col("conversion_factor").isNotNull()).groupBy("source_unit", "target_unit")
            .agg(F.min(F.struct("conversion_factor", "conversion_offset")).alias("f")).collect())
    return {(r[0], r[1]): (r["f"][0], r["f"][1] or 0) for r in rows}


def _join_lookups(raw: DataFrame, template: Template, lookups: dict[str, DataFrame]) -> DataFrame:
    """P04 for mappings that name a lookup table (``lookup_ref``): one joined
    column per mapping, which its transform then reads."""
    for m in [*template.field_mappings, *template.feature_mappings]:
        cfg = m.transform_config or {}
        if m.transform_type == "lookup" and cfg.get("lookup_ref") and m.src_column in raw.columns:
            default = cfg.get("default_value")
            raw = lookup_join(raw, m.src_column, lookups[cfg["lookup_ref"]], _lookup_column(m), None if default is None else str(default))
    return raw


def _lookup_column(m) -> str:
    return f"__lookup_{m.src_column}_{m.transform_config['lookup_ref']}_{m.transform_config.get('default_value')}"


def _compile_transform(m, cols: set[str], value: Column, uom_factors: dict):
    tt = m.transform_type or "direct"
    cfg = m.transform_config or {}
    if tt == "lookup" and cfg.get("lookup_ref"):
        return _src(cols, _lookup_column(m)), None
    if tt == "uom_convert":
        a, b = cfg.get("from_unit", ""), cfg.get("to_unit", "")
        f, o = uom_factors.get((a, b), (None, None)) if (a and b) else (None, None)
        return t_uom_convert(value, cfg, cols, f, o)
    fn = TRANSFORMS.get(tt)
    if fn is None:
        return F.lit(None).cast("string"), F.lit(f"Unknown transform type: {tt}")
    return fn(value, cfg, cols)


def apply_template(raw: DataFrame, template: Template, uom: DataFrame | None = None,
                   keys: tuple[str, ...] = ("client_id", "ingest_id", "row_num"),
                   lookups: dict[str, DataFrame] | None = None) -> DataFrame:
    """Map raw all-string rows to product + features + issues.
    ``lookups`` holds the tables (key, value, ordinal) that lookups name by
    ``lookup_ref`` instead of carrying their entries."""
    raw = _join_lookups(raw, template, lookups or {})
    cols = set(raw.columns)
    uom_pairs = {(m.transform_config.get("from_unit"), m.transform_config.get("to_unit"))
                 for m in list(template.field_mappings) + list(template.feature_mappings)
                 if m.transform_type == "uom_convert" and m.transform_config.get("from_unit")
                 and m.transform_config.get("to_unit")}
    factors = _resolve_uom_pairs(raw.sparkSession, uom, uom_pairs)

    product_values: dict[str, list[Column]] = {}
    issues: list[Column] = []
    for m in template.field_mappings:
        raw_v = _src(cols, m.src_column)
        missing = is_missing(raw_v)
        val, err = _compile_transform(m, cols, raw_v, factors)
        default = F.lit(m.default_value).cast("string")
        if m.is_required:
            issues.append(F.when(missing, F.struct(
                F.lit("field_mapping_error").alias("type"), F.lit(m.src_column).alias("field"),
                F.lit(f"Required field '{m.src_column}' is missing").alias("error"))))
        if err is not None:
            issues.append(F.when(~missing & err.isNotNull(), F.struct(
                F.lit("field_mapping_error").alias("type"), F.lit(m.src_column).alias("field"),
                err.alias("error"))))
            val = F.when(err.isNull(), val)
        value = F.when(missing, F.lit(None).cast("string") if m.is_required else default) \
                 .otherwise(val.cast("string"))
        product_values.setdefault(m.target_column, []).append(value)

    targets = list(PRODUCT_FIELDS) + [t for t in product_values if t not in PRODUCT_FIELDS]
    product = F.struct(*[
        (F.coalesce(*reversed(product_values[t])) if t in product_values
         else F.lit(None).cast("string")).alias(t) for t in targets])

    features = []
    for m in template.feature_mappings:
        raw_v = _src(cols, m.src_column)
        missing = is_missing(raw_v)
        val, err = _compile_transform(m, cols, raw_v, factors)
        if m.is_required:
            issues.append(F.when(missing, F.struct(
                F.lit("feature_mapping_error").alias("type"), F.lit(m.etim_feature).alias("field"),
                F.lit(f"Required feature '{m.src_column}' is missing").alias("error"))))
        if err is not None:
            issues.append(F.when(~missing & err.isNotNull(), F.struct(
                F.lit("feature_mapping_error").alias("type"), F.lit(m.etim_feature).alias("field"),
                err.alias("error"))))
            ok = ~missing & err.isNull()
        else:
            ok = ~missing
        features.append(F.when(ok, F.struct(
            F.lit(m.etim_feature).alias("etim_feature"),
            raw_v.alias("value_raw"),
            _src(cols, m.unit_column).alias("unit_raw"),
            val.cast("string").alias("value_transformed"),
            F.lit(m.src_column).alias("source_column"))))

    feat_arr = (F.filter(F.array(*features), lambda x: x.isNotNull()) if features
                else F.array().cast(T.ArrayType(FEATURE_TYPE)))
    issue_arr = (F.filter(F.array(*issues), lambda x: x.isNotNull()) if issues
                 else F.array().cast(T.ArrayType(ISSUE_TYPE)))
    key_cols = [k for k in keys if k in cols]
    return raw.select(*key_cols, product.alias("product"), feat_arr.alias("features"),
                      issue_arr.alias("issues"))


def flatten_product(mapped: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Product struct -> top-level columns (keys kept)."""
    keys = [c for c in mapped.columns if c not in ("product", "features", "issues")]
    fields = fields or PRODUCT_FIELDS
    return mapped.select(*keys, *[F.col(f"product.{f}").alias(f) for f in fields])


# ---------------------------------------------------------------------------
# Template tables (P10, P11): choose the active latest version per client,
# assemble field and feature mappings per template.
# ---------------------------------------------------------------------------

def choose_templates(templates: DataFrame) -> DataFrame:
    """P10: per client, the active template with the highest version
    (ties broken by template_id so the choice is deterministic)."""
    active = templates.filter(F.col("is_active"))
    best = active.groupBy("client_id").agg(
        F.max_by(F.struct(*templates.columns), F.struct("version", "template_id")).alias("t"))
    return best.select("t.*")


def assemble_templates(templates: DataFrame, fields: DataFrame, features: DataFrame) -> DataFrame:
    """One row per template with its mappings as arrays.

    The reference uses correlated ``json_agg`` subqueries; here both sides
    are pre-aggregated per template_id, then left-joined."""
    f = fields.groupBy("template_id").agg(
        F.sort_array(F.collect_list(F.struct(*[c for c in fields.columns if c != "template_id"])))
        .alias("field_mappings"))
    g = features.groupBy("template_id").agg(
        F.sort_array(F.collect_list(F.struct(*[c for c in features.columns if c != "template_id"])))
        .alias("feature_mappings"))
    return templates.join(f, "template_id", "left").join(g, "template_id", "left")


def template_from_row(row) -> Template:
    """Driver-side: one assembled template row (small metadata) -> Template."""
    def cfg(x):
        return json.loads(x) if isinstance(x, str) and x else (x or {})
    return Template(
        field_mappings=[FieldMapping(m["src_column"], m["target_column"],
                                     m["transform_type"] or "direct", cfg(m["transform_config"]),
                                     bool(m["is_required"]), m["default_value"])
                        for m in (row["field_mappings"] or [])],
        feature_mappings=[FeatureMapping(m["src_column"], m["etim_feature"], m["unit_column"],
                                         m["transform_type"] or "direct", cfg(m["transform_config"]),
                                         bool(m["is_required"]))
                          for m in (row["feature_mappings"] or [])],
        template_id=row["template_id"], client_id=row["client_id"], name=row["name"],
        version=row["version"])


def template_tables(spark: SparkSession, template: Template):
    """Template -> (map_template, map_field, map_feature) DataFrames."""
    tid = template.template_id or "tmpl"
    t = spark.createDataFrame(
        [(tid, template.client_id, template.name, int(template.version), True)],
        "template_id string, client_id string, name string, version int, is_active boolean")
    f = spark.createDataFrame(
        [(tid, m.src_column, "product", m.target_column, m.transform_type,
          json.dumps(m.transform_config or {}), m.is_required, m.default_value)
         for m in template.field_mappings],
        "template_id string, src_column string, target_table string, target_column string, "
        "transform_type string, transform_config string, is_required boolean, default_value string")
    g = spark.createDataFrame(
        [(tid, m.src_column, m.etim_feature, m.unit_column, m.transform_type,
          json.dumps(m.transform_config or {}), m.is_required) for m in template.feature_mappings],
        "template_id string, src_column string, etim_feature string, unit_column string, "
        "transform_type string, transform_config string, is_required boolean")
    return t, f, g


def application_check(job: DataFrame, templates: DataFrame, fields: DataFrame,
                      features: DataFrame) -> DataFrame:
    """May this template be applied to this job?

    Allowed when the template belongs to the job's client or is global; the
    job moves from ``created`` to ``mapped``; the mapping count is fields +
    features (each pre-counted per template, then joined)."""
    nf = fields.groupBy("template_id").agg(F.count("*").alias("n_fields"))
    ng = features.groupBy("template_id").agg(F.count("*").alias("n_features"))
    t = (templates.select("template_id", F.col("client_id").alias("template_client"))
         .join(nf, "template_id", "left").join(ng, "template_id", "left"))
    j = job.join(t, "template_id", "left")
    allowed = (F.col("template_client") == F.col("client_id")) | (F.col("template_client") == "global")
    return j.select(
        *job.columns,
        allowed.alias("allowed"),
        F.when(allowed & (F.col("status") == "created"), F.lit("mapped"))
         .otherwise(F.col("status")).alias("new_status"),
        (F.coalesce(F.col("n_fields"), F.lit(0)) + F.coalesce(F.col("n_features"), F.lit(0)))
        .cast("bigint").alias("mapping_count"))
