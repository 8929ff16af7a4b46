"""The reference's sample files (FIXTURES.md part A) through the whole
ingest path: discovery, dialect detection, scan, mapping, rules, gate."""

import os
import tempfile

from pyspark.sql import functions as F

from vetrina.operators import quality
from vetrina.operators.mapping import apply_template, demo_template
from vetrina.operators.rules import issues_long, validate
from vetrina.operators.suggest import name_rules_df, suggest_targets
from vetrina.sources import files as FS
from vetrina.sources.reference_data import seed_rules

PROBLEMATIC = [
    ("SKU", "Name", "Brand", "GTIN", "Length", "Price"),
    ("GOOD-001", "Good Product", "GoodBrand", "1234567890123", "25.5", "1.50"),
    ("", "Missing SKU Product", "TestBrand", "1234567890124", "30", "2.00"),
    ("BAD-001", "Invalid GTIN Product", "TestBrand", "invalid-gtin", "20", "1.25"),
    ("BAD-002", "Negative Length Product", "TestBrand", "1234567890125", "-5", "0.75"),
    ("BAD-003", "Missing Price Product", "TestBrand", "1234567890126", "15", ""),
]


def _ingest(spark, text, name):
    d = tempfile.mkdtemp(prefix="vt-sample-")
    with open(os.path.join(d, name), "w") as f:
        f.write(text)
    adm = FS.admission(FS.discover(spark, d)).collect()
    assert len(adm) == 1 and adm[0].valid
    lines = spark.read.text(d).select(F.col("_metadata.file_path").alias("file_id"),
                                      F.col("value").alias("line"), F.lit(0).alias("line_no"))
    sep = FS.detect_delimiter(lines).first().delimiter
    df = FS.number_rows(FS.read_delimited(spark, [adm[0].path], sep, True, adm[0].encoding))
    return sep, df.withColumn("client_id", F.lit("demo")).withColumn("ingest_id", F.lit("problematic"))


def test_problematic_sample(spark):
    text = "\n".join(",".join(r) for r in PROBLEMATIC) + "\n"
    sep, df = _ingest(spark, text, "problematic_sample.csv")
    assert sep == ","
    mapped = apply_template(df, demo_template())
    for compat, expected, status in [
        (False, {("Required SKU", 1), ("GTIN Format", 2), ("Positive Length", 3)}, "FAIL"),
        (True, {("GTIN Format", 2), ("Positive Length", 3)}, "FAIL"),
    ]:
        v = validate(mapped, seed_rules(compat), compat=compat)
        got = {(r.rule_name, r.row_num) for r in issues_long(v).collect()}
        assert got == expected
        g = quality.gate(v, compat=compat).first()
        assert g.total_rows == 5 and g.gate_status == status
    msg = [r.message for r in issues_long(validate(mapped, seed_rules())).collect()
           if r.rule_name == "Positive Length"]
    assert msg == ["Value -5.0 must be greater than 0"]


def test_semicolon_german_headers(spark):
    rows = ["Artikel;Bezeichnung;Marke;EAN;Preis"] + [
        f"ART-{i:03d};Schraube {i};Marke{i % 3};400{i:010d};{1 + i % 19}.50" for i in range(1, 21)]
    sep, df = _ingest(spark, "\n".join(rows) + "\n", "semicolon_sample.csv")
    assert sep == ";" and df.count() == 20
    header = [c for c in df.columns if c not in ("file_path", "_block", "row_num", "client_id", "ingest_id")]
    assert header == ["Artikel", "Bezeichnung", "Marke", "EAN", "Preis"]
    cols = spark.createDataFrame([("f", i, c) for i, c in enumerate(header)],
                                 "file_id string, ordinal int, column_name string")
    default = {r.column_name: r.target for r in suggest_targets(cols, name_rules_df(spark)).collect()}
    compat = {r.column_name: r.target for r in
              suggest_targets(cols, name_rules_df(spark, compat=True), compat=True).collect()}
    assert default == {"Artikel": "sku", "Bezeichnung": "product_name", "Marke": "brand", "EAN": "gtin"}
    assert "Artikel" not in compat and compat["EAN"] == "gtin"          # SURVEY 3.5 #16
