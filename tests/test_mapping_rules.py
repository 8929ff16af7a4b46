"""Mapping transforms, rule evaluation and the gate on literal frames,
including each SURVEY 3.5 decision in default and compat mode."""

from pyspark.sql import functions as F

from vetrina.operators import quality
from vetrina.operators.mapping import (FeatureMapping, FieldMapping, Template, apply_template,
                                       assemble_templates, choose_templates, template_from_row,
                                       template_tables)
from vetrina.operators.rules import issues_long, load_rules, validate
from vetrina.sources.reference_data import etim_class_feature_df, seed_rules, uom_df

COLS = "client_id string, ingest_id string, row_num bigint, SKU string, Name string, Val string, Unit string"


def frame(spark, rows):
    return spark.createDataFrame(rows, COLS)


def product(df, col):
    return [r[0] for r in df.orderBy("row_num").select(F.col(f"product.{col}")).collect()]


def test_transforms(spark):
    rows = [("c", "i", 0, " ab ", "red  bolt", "10", "cm"),
            ("c", "i", 1, "", "x", "abc", "mm"),
            ("c", "i", 2, "'Q'", "one two three", "0", "in")]
    t = Template(
        field_mappings=[
            FieldMapping("SKU", "sku", "direct", {"remove_quotes": True, "uppercase": True}, True),
            FieldMapping("Unit", "u", "lookup", {"lookup_table": {"CM": "centi", "mm": "milli"}}),
            FieldMapping("Val", "half", "formula", {"formula": "{value} / 2"}),
            FieldMapping("Val", "inv", "formula", {"formula": "10 / {value}"}),
            FieldMapping("Name", "w3", "split", {"separator": " ", "index": 2}),
            FieldMapping("Name", "nu", "concat", {"columns": ["Unit"], "separator": "-"}),
            FieldMapping("Name", "re", "regex", {"pattern": r"(\w+) (\w+)", "replacement": r"\2 \1"}),
            FieldMapping("Name", "bad", "regex", {"pattern": "(", "replacement": "x"}),
            FieldMapping("Val", "mm", "uom_convert", {"from_unit": "cm", "to_unit": "mm"}),
        ],
        feature_mappings=[FeatureMapping("Val", "EF001001", "Unit")])
    m = apply_template(frame(spark, rows), t, uom=uom_df(spark))
    assert product(m, "sku") == ["AB", None, "Q"]
    assert product(m, "u") == ["centi", "milli", "in"]
    # Python: "10 / 2" is the float 5.0
    assert product(m, "half") == ["5.0", "abc", "0.0"]
    # division by zero keeps the original value, as the reference's except path does
    assert product(m, "inv") == ["1.0", "abc", "0"]
    # "red  bolt".split(" ") == ["red", "", "bolt"]; "x" has no third part
    assert product(m, "w3") == ["bolt", "x", "three"]
    assert product(m, "nu") == ["red  bolt-cm", "x-mm", "one two three-in"]
    assert product(m, "re") == ["red  bolt", "x", "two one three"]
    assert product(m, "bad") == ["red  bolt", "x", "one two three"]
    assert product(m, "mm") == ["100.0", None, "0.0"]
    issues = [r[0] for r in m.orderBy("row_num").select(F.size("issues")).collect()]
    assert issues == [0, 2, 0]   # missing required SKU + non-numeric uom value


def test_split_index_out_of_range_keeps_value(spark):
    t = Template([FieldMapping("Name", "w", "split", {"separator": ",", "index": 5})], [])
    m = apply_template(frame(spark, [("c", "i", 0, "s", "a,b", "1", "mm")]), t)
    assert product(m, "w") == ["a,b"]


def _rules_on(spark, rows, compat):
    t = Template([FieldMapping("SKU", "sku", is_required=True), FieldMapping("Name", "gtin")],
                 [FeatureMapping("Val", "EF001001", "Unit")])
    m = apply_template(frame(spark, rows), t)
    return issues_long(validate(m, seed_rules(compat), compat=compat))


def test_required_absent_counts_only_by_default(spark):
    rows = [("c", "i", 0, "", "12345678", "5", "mm"), ("c", "i", 1, "   ", "12345678", "5", "mm")]
    default = {(r.row_num, r.rule_name) for r in _rules_on(spark, rows, False).collect()}
    compat = {(r.row_num, r.rule_name) for r in _rules_on(spark, rows, True).collect()}
    assert (0, "Required SKU") in default and (0, "Required SKU") not in compat      # 3.5 #1
    assert (1, "Required SKU") in default and (1, "Required SKU") in compat


def test_gtin_pattern_anchoring(spark):
    rows = [("c", "i", 0, "s1", "123456789X", "5", "mm"), ("c", "i", 1, "s2", "12345678", "5", "mm")]
    default = {r.row_num for r in _rules_on(spark, rows, False).collect() if r.rule_name == "GTIN Format"}
    compat = {r.row_num for r in _rules_on(spark, rows, True).collect() if r.rule_name == "GTIN Format"}
    assert default == {0} and compat == set()                                          # 3.5 #2


def test_range_messages(spark):
    rows = [("c", "i", 0, "s", "12345678", "-5", "mm"), ("c", "i", 1, "s", "12345678", "1,2", "mm"),
            ("c", "i", 2, "s", "12345678", "0", "mm"), ("c", "i", 3, "s", "12345678", "3", "mm")]
    got = {r.row_num: r.message for r in _rules_on(spark, rows, False).collect() if r.rule_type == "range"}
    assert got == {0: "Value -5.0 must be greater than 0", 1: "Value '1,2' is not numeric",
                   2: "Value 0.0 must be greater than 0"}


def test_rule_order_by_severity_rank():
    rules = seed_rules() + [{"rule_id": "x", "name": "A info", "rule_type": "required", "target_type": "field",
                             "target_name": "sku", "rule_config": {}, "severity": "INFO"}]
    order = [r["severity"] for r in load_rules(rules)]
    assert order == sorted(order, key=lambda s: -{"ERROR": 3, "WARN": 2, "INFO": 1}[s])     # 3.5 #10


def test_etim_mandatory_feature(spark):
    rows = [("c", "i", 0, "s", "EC000123", "", "mm"), ("c", "i", 1, "s", "EC000456", "", "mm")]
    t = Template([FieldMapping("SKU", "sku"), FieldMapping("Name", "etim_class")],
                 [FeatureMapping("Val", "EF001002")])
    rule = [{"rule_id": "e", "name": "Diameter", "rule_type": "etim", "target_type": "feature",
             "target_name": "EF001002", "rule_config": {}, "severity": "ERROR"}]
    v = validate(apply_template(frame(spark, rows), t), rule, class_features=etim_class_feature_df(spark))
    assert [r.row_num for r in issues_long(v).collect()] == [0]


def test_gate_edges(spark):
    agg = spark.createDataFrame([("c", "a", 0, 0, 0), ("c", "b", 10, 1, 0), ("c", "d", 2, 30, 5)],
                                "client_id string, ingest_id string, total_rows long, error_count long, "
                                "warning_count long")
    g = {r.ingest_id: r for r in quality.gate_from_counts(agg).collect()}
    assert g["a"].gate_status == "PASS" and g["a"].overall_score == 1.0                # 3.5 #12
    assert g["b"].gate_status == "PASS"   # one error, score 0.925 >= 0.8             # 3.5 #11
    assert g["d"].validity == 0.0                                                      # 3.5 #13
    gc = {r.ingest_id: r for r in quality.gate_from_counts(agg, compat=True).collect()}
    assert gc["d"].validity < 0


def test_template_tables_roundtrip(spark):
    t = Template([FieldMapping("SKU", "sku", is_required=True),
                  FieldMapping("P", "price", "formula", {"formula": "{value} * 2"})],
                 [FeatureMapping("L", "EF001001", "LU")], template_id="t1", client_id="c", name="n", version=3)
    tt, ff, gg = template_tables(spark, t)
    older = spark.createDataFrame([("t0", "c", "n", 1, True), ("t9", "c", "n", 9, False)],
                                  "template_id string, client_id string, name string, version int, "
                                  "is_active boolean")
    chosen = choose_templates(tt.unionByName(older))
    assert [r.template_id for r in chosen.collect()] == ["t1"]
    row = assemble_templates(chosen, ff, gg).collect()[0]
    back = template_from_row(row)
    assert {m.target_column for m in back.field_mappings} == {"sku", "price"}
    assert back.feature_mappings[0].unit_column == "LU"
