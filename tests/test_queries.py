"""Every registered query against its DuckDB oracle on sf0.001, and
partition-count invariance of the flagship."""

import pytest

from vetrina.plans import ORACLES, QUERIES
from vetrina.plans.compare import compare, rows_of
from tests.conftest import SMALL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    r = compare(spark, duck, name, SMALL, QUERIES, ORACLES)
    assert r["status"] in ("match", "rows-only"), r


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("parts", ["1", "7"])
def test_partition_invariance(spark, parts):
    base = rows_of(*_rows(QUERIES["a11_gate"](spark, SMALL)))
    prev = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = rows_of(*_rows(QUERIES["a11_gate"](spark, SMALL).repartition(int(parts))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", prev)
    assert got == base


def _rows(df):
    return df.columns, [tuple(r) for r in df.collect()]
