"""DuckDB SQL fragments for the oracles.

The oracle SQL restates each operator's semantics in plain SQL; these
helpers keep the number grammar and whitespace class identical to the
Spark side (see ``vetrina.functions.normalize``).
"""

from __future__ import annotations

from vetrina.functions.normalize import NUMBER_RE, WS


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def missing(x: str) -> str:
    return f"({x} IS NULL OR {x} = '')"


def blank(x: str) -> str:
    return f"({x} IS NULL OR {strip(x)} = '')"


def pyfloat(x: str) -> str:
    """Python float() for plain decimal text (no inf/nan in fixtures)."""
    s = strip(x)
    return f"(CASE WHEN regexp_full_match({s}, '{NUMBER_RE[1:-1]}') THEN TRY_CAST({s} AS DOUBLE) END)"


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"
