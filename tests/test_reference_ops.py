"""Reference-data and metadata operators: V12, P15/A25, E09/E10, P16."""

from vetrina.operators import reports as RP
from vetrina.operators import resolve as R
from vetrina.operators.mapping import application_check
from vetrina.operators.suggest import suggest_rules_from_reference
from vetrina.sources.reference_data import etim_class_feature_df, etim_feature_df


def test_rule_suggestions_from_reference(spark):
    got = {(r.feature_code, r.suggestion, r.confidence) for r in
           suggest_rules_from_reference(etim_class_feature_df(spark), etim_feature_df(spark)).collect()}
    assert ("EF001001", "etim_required", 1.0) in got and ("EF001001", "etim_numeric", 0.95) in got
    assert ("EF001003", "etim_required", 1.0) not in got          # not mandatory
    assert not any(f == "EF001005" for f, _, _ in got)             # alphanumeric, optional


def test_template_application_check(spark):
    jobs = spark.createDataFrame([("j1", "c1", "created", "t1"), ("j2", "c2", "created", "t1"),
                                  ("j3", "c2", "created", "tg")],
                                 "job_id string, client_id string, status string, template_id string")
    templates = spark.createDataFrame([("t1", "c1"), ("tg", "global")], "template_id string, client_id string")
    fields = spark.createDataFrame([("t1", "SKU"), ("t1", "Name"), ("tg", "SKU")], "template_id string, src string")
    feats = spark.createDataFrame([("t1", "L")], "template_id string, src string")
    got = {r.job_id: (r.allowed, r.new_status, r.mapping_count)
           for r in application_check(jobs, templates, fields, feats).collect()}
    assert got == {"j1": (True, "mapped", 3), "j2": (False, "created", 3), "j3": (True, "mapped", 1)}


def test_insert_if_absent_and_upsert_by_key(spark):
    base = spark.createDataFrame([("c", "i1", 10), ("c", "i2", 20)], "client_id string, ingest_id string, n int")
    rows = spark.createDataFrame([("c", "i2", 99), ("c", "i3", 30)], "client_id string, ingest_id string, n int")
    keys = ["client_id", "ingest_id"]
    ins = {(r.ingest_id, r.n) for r in R.insert_if_absent(base, rows, keys).collect()}
    ups = {(r.ingest_id, r.n) for r in R.upsert_by_key(base, rows, keys).collect()}
    assert ins == {("i1", 10), ("i2", 20), ("i3", 30)}             # E10: ON CONFLICT DO NOTHING
    assert ups == {("i1", 10), ("i2", 99), ("i3", 30)}             # E09: insert or replace
    # applying either twice changes nothing
    assert {tuple(r) for r in R.upsert_by_key(R.upsert_by_key(base, rows, keys), rows, keys).collect()} == \
        {tuple(r) for r in R.upsert_by_key(base, rows, keys).collect()}


def test_tenant_scope(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("global", 3)], "client_id string, v int")
    assert sorted(r.v for r in RP.tenant_scope(df, "a").collect()) == [1, 3]
