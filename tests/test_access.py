"""Joined lookups and domains, keyset pages, skewed staging, JSON paths."""

import pytest
from pyspark.sql import functions as F

from vetrina.functions import records as REC
from vetrina.operators.mapping import FieldMapping, Template, apply_template
from vetrina.operators.paging import page, token_of
from vetrina.operators.rules import issues_long, validate
from vetrina.sources import staging as ST


@pytest.fixture(scope="module")
def big_table(spark):
    rows = spark.range(100_000).select(F.concat(F.lit("Key"), "id").alias("key"), F.concat(F.lit("v"), "id").alias("value"), F.col("id").alias("ordinal"))
    extra = spark.createDataFrame([("key5", "lower", 200_000), ("KEY5", "upper", 200_001), ("Key7", "late", 200_002), (None, "null key", 1), ("nul", None, 200_003), ("", "empty", 200_004)], "key string, value string, ordinal long")
    return rows.unionByName(extra)


def raw(spark, cells):
    return spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "row_num long, M string")


CELLS = ["Key5", " key5 ", "KEY5", "kEY5", "Key7", "kEY99999", "nul", "missing", None, "", None] + [None] * 40


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_lookup_from_a_large_table(spark, big_table, threshold):
    t = Template([FieldMapping("M", "model", "lookup", {"lookup_ref": "big"}), FieldMapping("M", "brand", "lookup", {"lookup_ref": "big", "default_value": "?"})], [])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        mapped = apply_template(raw(spark, CELLS), t, keys=("row_num",), lookups={"big": big_table})
        got = [(r.model, r.brand) for r in mapped.select("row_num", "product.model", "product.brand").orderBy("row_num").collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(got) == len(CELLS)
    assert got[:8] == [("v5", "v5"), ("lower", "lower"), ("upper", "upper"), ("v5", "v5"), ("v7", "v7"), ("v99999", "v99999"), (None, None), ("missing", "?")]
    assert set(got[8:]) == {(None, None)}


def test_nulls_do_not_meet_in_one_task(spark, big_table):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        from vetrina.operators.mapping import lookup_join
        nulls = spark.range(4000).select("id", F.lit(None).cast("string").alias("M")).repartition(3)
        out = lookup_join(nulls, "M", big_table.limit(10), "x").select(F.spark_partition_id().alias("p"))
        sizes = [r["count"] for r in out.groupBy("p").count().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum(sizes) == 4000 and max(sizes) < 2500


def test_domain_from_a_large_table(spark, big_table):
    rule = {"rule_id": "d", "name": "d", "rule_type": "domain", "target_type": "field", "target_name": "model", "severity": "ERROR", "rule_config": {"values_ref": "big"}}
    loose = rule | {"rule_id": "e", "name": "e", "rule_config": {"values_ref": "big", "case_sensitive": False}}
    mapped = apply_template(raw(spark, CELLS), Template([FieldMapping("M", "model")], []), keys=("row_num",))
    checked = validate(mapped, [rule, loose], domains={"big": big_table.select(F.col("key").alias("value"))})
    assert checked.count() == len(CELLS) and not [c for c in checked.columns if c.startswith("__")]
    bad = sorted((r.row_num, r.rule_id) for r in issues_long(checked, ("row_num",)).collect())
    assert bad == [(3, "d"), (5, "d"), (7, "d"), (7, "e")]


def test_pages_concatenate_under_inserts(spark):
    keys = ["t", "id"]
    rows = [(None if i % 10 == 0 else i // 4, i) for i in range(103)]
    df = spark.createDataFrame(rows, "t int, id int").repartition(4)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    got, token, inserted = [], None, []
    while True:
        one = page(df, keys, 20, token)
        got += [tuple(r) for r in one.collect()]
        token = token_of(one, keys, 20)
        if token is None:
            break
        inserted.append((1000, 5000 + len(inserted)))  # newer rows come in while paging
        df = df.unionByName(spark.createDataFrame(inserted[-1:], "t int, id int"))
    assert got == want
    assert page(df.where("false"), keys, 20).count() == 0


def test_page_filter_reaches_the_scan(spark, tmp_path):
    spark.range(1000).select("id", (F.col("id") % 7).alias("t")).write.parquet(str(tmp_path / "t"))
    plan = page(spark.read.parquet(str(tmp_path / "t")), ["t", "id"], 5, (3, 500))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "LessThan(t,3)" in plan.replace(" ", "")


def test_hot_ingest_is_written_by_many_tasks(spark, tmp_path):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 20)).alias("client_id"), F.lit("i").alias("ingest_id"), F.col("id").alias("row_num"))
    ST.write_staging(df, str(tmp_path / "s"), partitions=9)
    files = spark.read.parquet(str(tmp_path / "s")).select("client_id", "row_num", F.col("_metadata.file_path").alias("f"))
    n = {r.client_id: (r.files, r.rows) for r in files.groupBy("client_id").agg(F.count_distinct("f").alias("files"), F.count("*").alias("rows")).collect()}
    assert n["hot"][1] == 3000 and n["hot"][0] >= 3 and all(v[0] <= 2 for k, v in n.items() if k != "hot")
    assert [r.row_num for r in ST.read_staging(spark, str(tmp_path / "s"), "hot", "i", ordered=True).collect()] == list(range(0, 9000, 3))


def test_json_paths(spark):
    df = spark.createDataFrame([('{"a": {"b": {"c": 1}, "$d": "x"}, "l": [{"k": "u"}, {"k": "v"}]}',), ("{}",), ("broken",), (None,)], "doc string")
    ddl = "a struct<b: struct<c: int>, `$d`: string>, l array<struct<k: string>>"
    got = df.select(*[REC.json_field("doc", p, ddl).alias(n) for n, p in (("c", "$.a.b.c"), ("d", "$.a.$d"), ("k", "$.l[1].k"), ("out", "$.l[9].k"))]).collect()
    assert [tuple(r) for r in got] == [(1, "x", "v", None)] + [(None,) * 4] * 3


def test_stages_of_every_status(spark):
    df = spark.createDataFrame([(s,) for s in [*REC.STAGE_PROGRESS, "odd", None]], "s string").select("s", REC.completed_stages("s").alias("done"), REC.remaining_stages("s").alias("left"))
    got = {r.s: (r.done, r.left) for r in df.collect()}
    assert got["completed"] == (REC.ALL_STAGES[1:], []) and got["failed"] == ([], REC.ALL_STAGES) == got["odd"]
    assert got["validated"] == (["profiling", "mapping", "validation"], ["upload", "normalization", "execution", "completion"])
