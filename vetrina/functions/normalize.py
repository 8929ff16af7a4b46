"""Scalar normalisation expressions.

Every function takes and returns a ``Column`` built from Spark's own
expressions, so it stays inside whole-stage code generation; none of them is
a Python UDF.  Where Python's parsing rules (the reference's) differ from
Spark's casts, a regex guard in front of ``try_cast`` pins the grammar.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference (kept verbatim).
# ---------------------------------------------------------------------------
CURRENCY_NAMES = {
    "EURO": "EUR", "EUROS": "EUR",
    "DOLLAR": "USD", "DOLLARS": "USD",
    "POUND": "GBP", "POUNDS": "GBP",
    "YEN": "JPY",
}
DEFAULT_CURRENCY = "USD"
TRUE_WORDS = ["true", "yes", "y", "1", "on", "enabled", "ja", "oui", "si"]
FALSE_WORDS = ["false", "no", "n", "0", "off", "disabled", "nein", "non"]
GTIN_LENGTHS = (8, 12, 13, 14)
# Date-like prefixes used by the profiler's type guess.
DATE_PREFIXES = [r"\d{4}-\d{2}-\d{2}", r"\d{2}/\d{2}/\d{4}", r"\d{2}\.\d{2}\.\d{4}"]

# Whitespace as Python's str.strip sees it for ASCII text.
WS = r"[ \t\n\x0B\f\r]"
# Plain decimal number, optionally signed, with optional exponent.
NUMBER_RE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
# Python float() also takes inf / infinity / nan in any case.
SPECIAL_FLOAT_RE = r"^[+-]?(?i)(inf|infinity|nan)$"


def lit_or_col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def py_strip(c) -> Column:
    """``str.strip()``: drop leading and trailing whitespace."""
    return F.regexp_replace(lit_or_col(c), f"^{WS}+|{WS}+$", "")


def is_blank(c) -> Column:
    """null, "" or whitespace only."""
    c = lit_or_col(c)
    return c.isNull() | (py_strip(c) == "")


def is_missing(c) -> Column:
    """The mapping contract: null or the empty string (blank is present)."""
    c = lit_or_col(c)
    return c.isNull() | (c == "")


def python_float(c) -> Column:
    """``float(x)`` of Python for plain decimal text, else null.

    Inputs Python would accept but this grammar rejects (``1_000``) and
    inputs Spark alone would accept (``12d``) both give null here.
    """
    s = py_strip(lit_or_col(c))
    special = F.lower(F.regexp_replace(s, "^[+-]", ""))
    sign = F.when(s.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    return (F.when(s.rlike(NUMBER_RE), s.try_cast("double"))
             .when(s.rlike(SPECIAL_FLOAT_RE),
                   F.when(special == "nan", F.lit(float("nan")))
                    .otherwise(sign * F.lit(float("inf")))))


def is_numeric_text(c) -> Column:
    """``float(value.replace(',', ''))`` succeeds (after strip)."""
    return python_float(F.regexp_replace(lit_or_col(c), ",", "")).isNotNull()


def is_date_like(c) -> Column:
    """stripped value starts with one of the three date shapes."""
    s = py_strip(c)
    cond = F.lit(False)
    for p in DATE_PREFIXES:
        cond = cond | s.rlike("^" + p)
    return cond


def normalize_text(c, case: str | None = None) -> Column:
    """null -> ""; strip; runs of 2+ whitespace -> one space; case."""
    s = F.regexp_replace(py_strip(F.coalesce(lit_or_col(c).cast("string"), F.lit(""))),
                         r"\s{2,}", " ")
    if case == "upper":
        return F.upper(s)
    if case == "lower":
        return F.lower(s)
    return s


def normalize_numeric(c, precision: int = 6) -> Column:
    """decimal text -> DECIMAL(38, precision), half-even, else null.

    Steps: strip; drop ',' and ' '; a single '.' followed by exactly three
    digits is a thousands mark and is dropped ("1.250" -> 1250); parse;
    round half to even.  Each step is one expression applied once (no
    intermediate is re-derived), which keeps generated code small when
    many numeric fields are normalised in one projection.
    """
    raw = lit_or_col(c)
    s = F.regexp_replace(raw, f"^{WS}+|{WS}+$|[, ]", "")
    s = F.regexp_replace(s, r"^([^.]*)\.([0-9]{3})$", "$1$2")
    out = F.bround(s.try_cast("decimal(38,18)"), precision).cast(f"decimal(38,{precision})")
    return F.when(raw.isNull() | (raw == ""), F.lit(None).cast(f"decimal(38,{precision})")) \
            .otherwise(out)


def normalize_price(c) -> Column:
    """F02 at two places; negatives become 0.00."""
    v = normalize_numeric(c, 2)
    return F.when(v < 0, F.lit(0).cast("decimal(38,2)")).otherwise(v)


def normalize_currency(c) -> Column:
    """null -> USD; strip + upper; currency names -> ISO codes."""
    s = F.upper(py_strip(lit_or_col(c)))
    names = F.create_map(*[F.lit(x) for kv in CURRENCY_NAMES.items() for x in kv])
    return F.when(lit_or_col(c).isNull(), F.lit(DEFAULT_CURRENCY)) \
            .otherwise(F.coalesce(F.try_element_at(names, s), s))


def normalize_gtin(c, pad_to_14: bool = False) -> Column:
    """keep digits; length 8/12/13/14 else null; one leading zero for
    12 and 13 digits (12 -> 13 as in the reference; ``pad_to_14`` pads 12
    digits to 14)."""
    raw = lit_or_col(c)
    d = F.regexp_replace(raw, r"[^0-9]", "")
    if pad_to_14:
        g = F.regexp_replace(F.regexp_replace(d, r"^([0-9]{12})$", "00$1"), r"^([0-9]{13})$", "0$1")
        ok = F.length(g).isin(8, 14)
    else:
        # 12 -> 13 and 13 -> 14 digits; valid originals end as 8, 13 or 14.
        g = F.regexp_replace(d, r"^([0-9]{12,13})$", "0$1")
        ok = F.length(g).isin(8, 13, 14)
    return F.when(raw.isNull() | (raw == ""), F.lit(None).cast("string")).when(ok, g)


def normalize_boolean(c) -> Column:
    """multilingual yes/no words -> boolean, else null."""
    raw = lit_or_col(c)
    s = F.lower(py_strip(raw))
    return (F.when(raw.isNull() | (raw == ""), F.lit(None).cast("boolean"))
             .when(s.isin(*TRUE_WORDS), F.lit(True))
             .when(s.isin(*FALSE_WORDS), F.lit(False))
             .otherwise(F.lit(None).cast("boolean")))


def typed_value(value, data_type) -> Column:
    """dispatch on the ETIM data type N / A / L (unknown behaves as A).

    A single column cannot hold a decimal, a string and a boolean, so the
    result is a struct of three typed slots plus the type used.
    """
    v, t = lit_or_col(value), lit_or_col(data_type)
    t = F.when(t.isin("N", "L"), t).otherwise(F.lit("A"))
    return F.struct(
        t.alias("data_type"),
        F.when(t == "N", normalize_numeric(v)).alias("value_number"),
        F.when(t == "A", normalize_text(v)).alias("value_text"),
        F.when(t == "L", normalize_boolean(v)).alias("value_bool"),
    )


def zero_as_null(c) -> Column:
    """export rendering where 0 and null both print as empty."""
    c = lit_or_col(c)
    return F.when(c != 0, c)


def gtin_check_ok(c, compat: bool = False) -> Column:
    """GTIN checksum over 8/12/13/14 digits.

    Default weights 3,1,3,... from the digit next to the check digit (the
    GS1 rule, right for every length).  ``compat`` weights 1,3,1,... from the
    left, as the reference does; both agree on 13 digits only.
    """
    s = py_strip(lit_or_col(c))
    n = F.length(s)
    body = F.sequence(F.lit(0), n - 2)
    digit = lambda i: F.substring(s, i + 1, 1).cast("int")
    if compat:
        weight = lambda i: F.when(i % 2 == 0, 1).otherwise(3)
    else:
        weight = lambda i: F.when((n - 2 - i) % 2 == 0, 3).otherwise(1)
    total = F.aggregate(F.transform(body, lambda i: digit(i) * weight(i)), F.lit(0),
                        lambda acc, x: acc + x)
    expected = (10 - total % 10) % 10
    shape_ok = s.rlike(r"^[0-9]+$") & n.isin(*GTIN_LENGTHS)
    return F.when(shape_ok, expected == F.substring(s, -1, 1).cast("int")).otherwise(F.lit(False))
