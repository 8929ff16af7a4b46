"""Upserts against stored tables: change classes, null and repeated keys,
order of arrival, counts by observation."""

import datetime

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from vetrina.operators import resolve as R
from vetrina.operators.upsert import change_counts, latest, upsert, write_counted
from vetrina.plans.compare import rows_of
from vetrina.plans.registry import QUERIES

SCHEMA = "k string, owner string, a string, b int"


def at(month):
    return F.lit(f"2024-0{month}-01").cast("timestamp")


def picked(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def stored(spark):
    rows = [("x", "o", "1", 1), ("y", "o", "2", None), ("z", None, "3", 3), (None, "o", "null key", 0)]
    return upsert(None, spark.createDataFrame(rows, SCHEMA), ["k"], ["a", "b"], at(1), fixed=["owner"]).drop("change").cache()


@pytest.mark.parametrize("how, want", [
    ("replace", [("x", "o", None, 1, "replace"), ("y", "o", "2", None, "same"), ("z", "p", "3", 3, "same"), (None, "o", "new", 0, "replace"), ("w", "p", "", None, "insert")]),
    ("fill", [("x", "o", "1", 1, "same"), ("y", "o", "2", None, "same"), ("z", "p", "3", 3, "same"), (None, "o", "new", 0, "replace"), ("w", "p", "", None, "insert")]),
    ("nothing", [("x", "o", "1", 1, "keep"), ("y", "o", "2", None, "keep"), ("z", None, "3", 3, "keep"), (None, "o", "null key", 0, "keep"), ("w", "p", "", None, "insert")])])
def test_upsert(spark, stored, how, want):
    rows = spark.createDataFrame([("x", "p", None, 1), ("y", "p", "2", None), ("z", "p", "3", 3), (None, "p", "new", 0), ("w", "p", "", None)], SCHEMA)
    out = upsert(stored, rows, ["k"], ["a", "b"], at(2), how, ["owner"])
    assert picked(out, "k", "owner", "a", "b", "change") == sorted(want, key=repr)
    jan, feb = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 2, 1)
    for r in out.collect():
        assert r.created_at == (feb if r.change == "insert" else jan) and r.updated_at == (feb if r.change in ("insert", "replace") else jan)
    twice = upsert(out.drop("change"), rows, ["k"], ["a", "b"], at(2), how, ["owner"])
    assert picked(twice, "k", "a", "b", "created_at", "updated_at") == picked(out, "k", "a", "b", "created_at", "updated_at")
    assert {r.change for r in twice.collect()} <= {"same", "keep"}


def test_upsert_empty_sides(spark, stored):
    none = stored.where("false")
    assert {r.change for r in upsert(stored, none, ["k"], ["a", "b"], at(2), fixed=["owner"]).collect()} == {"keep"}
    assert {r.change for r in upsert(none, stored, ["k"], ["a", "b"], at(2), fixed=["owner"]).collect()} == {"insert"}
    assert upsert(none, none, ["k"], ["a", "b"], at(2)).count() == 0


def test_null_is_not_empty(spark):
    a = spark.createDataFrame([("k", None, "x")], "k string, a string, b string")
    b = spark.createDataFrame([("k", "", "x")], "k string, a string, b string")
    c = spark.createDataFrame([("k", "x", None)], "k string, a string, b string")
    for other in (b, c):
        assert upsert(a, other, ["k"], ["a", "b"]).first().change == "replace"


def test_latest_folds_repeated_keys(spark):
    df = spark.createDataFrame([("a", i, i % 7) for i in range(500)] + [("b", 1, 0), (None, 2, 0)], "k string, n int, v int").repartition(5)
    assert picked(latest(df, ["k"], ["n"]), "k", "n", "v") == sorted([("a", 499, 2), ("b", 1, 0), (None, 2, 0)], key=repr)


def test_observed_counts(spark, stored):
    out, counts = write_counted(upsert(stored, stored.where("k in ('x', 'y')"), ["k"], ["a", "b"], at(2), fixed=["owner"]), "test-counted", change_counts("t"))
    assert counts == {"t_insert": 0, "t_replace": 0, "t_same": 2, "t_keep": 2} and out.count() == 4


def test_last_writer_by_arrival(spark):
    """ing-9 sorts after ing-10, c1 after c0; the file that came last wins,
    value by value, when records merge."""
    t = lambda h: datetime.datetime(2024, 1, 1, h)
    rows = [("c1", "ing-9", t(1), 0, "S", "0001", "bolt", "b", "EC1", "9.00"), ("c1", "ing-10", t(2), 0, "S", "0001", "bolt", "b", "EC1", "10.00"),
            ("c0", "ing-2", t(3), 0, "P", "0001", "bolt", "b", "EC1", "3.00"), ("c1", "ing-11", t(4), 5, "S", "0001", "bolt", "b", "EC1", None)]
    batch = spark.createDataFrame(rows, "client_id string, ingest_id string, arrived_at timestamp, row_num long, sku string, gtin string, product_name string, brand string, etim_class string, price string")
    records = R.resolve(batch.repartition(3))["records"]
    product = R.upsert_products(records).collect()
    assert [(p.client_id, p.sku, p.price, p.ingest_id) for p in product] == [("c1", "S", "3.00", "ing-11")]
    assert {r.sku: r.price for r in records.collect()} == {"S": "10.00", "P": "3.00"}
    feats = batch.select("client_id", "ingest_id", "arrived_at", "row_num", "sku", F.lit(0).alias("pos"), F.lit("EF1").alias("etim_feature"), F.col("price").alias("value_raw"),
                         F.lit("mm").alias("unit_raw"), F.col("price").alias("value_normalized"), F.lit("mm").alias("unit_normalized"))
    assert [f.value_raw for f in R.upsert_features(feats.where("price is not null"), records).collect()] == ["3.00"]


@pytest.mark.parametrize("parts", ["1", "8"])
def test_import_does_not_depend_on_partitions(spark, parts):
    def rows():
        df = QUERIES["e06_import_snapshot"](spark, SMALL)
        return rows_of(df.columns, [tuple(r) for r in df.collect()])

    want, before = rows(), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert rows() == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
