"""File sources on files written here, and the streaming quarantine."""

import os
import tempfile

from pyspark.sql import functions as F

from vetrina.sources import files as FS
from vetrina.streaming import events as S


def test_admission_and_detection(spark):
    d = tempfile.mkdtemp(prefix="vt-adm-")
    open(f"{d}/a.csv", "w").write("SKU;Name;Price\nA-1;x;1.5\n\nA-2;;2\n")
    open(f"{d}/one.txt", "w").write("only one line")
    open(f"{d}/n.pdf", "w").write("%PDF\nx\n")
    open(f"{d}/l.csv", "wb").write("Name,Preis\nMüller,1\n".encode("latin-1"))
    adm = {os.path.basename(r.path): r for r in FS.admission(FS.discover(spark, d)).collect()}
    assert adm["a.csv"].valid and adm["a.csv"].encoding == "utf-8"
    assert adm["l.csv"].encoding == "iso-8859-1"
    assert not adm["one.txt"].valid and "at least a header" in adm["one.txt"].errors[0]
    assert not adm["n.pdf"].valid and adm["n.pdf"].errors == ["File extension .pdf not allowed"]
    docs = spark.createDataFrame([(1, "a;b;c\n1;2;3\n4;5;6"), (2, "x,y\n1,2,3"), (3, "1|2\n3|4"), (4, "solo")],
                                 "id int, text string")
    lines = FS.text_lines(docs, "id", "text")
    h = {r.file_id: r for r in FS.detect_header(lines, FS.detect_delimiter(lines)).collect()}
    assert h[1].delimiter == ";" and h[1].has_header and h[1].columns == ["a", "b", "c"]
    assert h[2].delimiter == "," and h[2].has_header          # widths differ
    assert h[3].delimiter == "|" and not h[3].has_header      # numeric first row
    assert h[4].has_header                                    # fewer than two lines


def test_row_numbers_across_splits(spark):
    d = tempfile.mkdtemp(prefix="vt-rows-")
    with open(f"{d}/big.csv", "w") as f:
        f.write("k,v\n")
        for i in range(20000):
            f.write(f"{i},{'x' * 20}\n")
    prev = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")   # force many splits
    try:
        df = FS.number_rows(FS.read_delimited(spark, [f"{d}/big.csv"], ",", True))
        assert df.rdd.getNumPartitions() > 1
        bad = df.filter(F.col("row_num") != F.col("k").cast("long")).count()
        assert bad == 0 and df.count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", prev)


def test_quarantine_and_dedup_stream(spark):
    d = tempfile.mkdtemp(prefix="vt-ev-")
    os.makedirs(f"{d}/in")
    lines = [
        '{"event_id":"1","event_type":"file.received","timestamp":"2024-01-01T00:00:00.000000","client_id":"c","ingest_id":"i","idempotency_key":"k1","payload":"{}"}',
        '{"event_id":"2","event_type":"file.received","timestamp":"2024-01-01T00:00:01.000000","client_id":"c","ingest_id":"i","idempotency_key":"k1","payload":"{}"}',
        'not json at all',
        '{"event_id":"3","event_type":"file.profiled","timestamp":"2024-01-01T00:01:00.000000","client_id":"c","idempotency_key":"k2","payload":"{}"}',
    ]
    open(f"{d}/in/part-0.json", "w").write("\n".join(lines) + "\n")
    good, bad = S.quarantine_split(S.read_events(spark, f"{d}/in"))
    out_good, out_bad = f"{d}/good", f"{d}/bad"
    S.run_available(S.dedup(good).select("event_id", "idempotency_key"), S.idempotent_sink(out_good),
                    f"{d}/ck1")
    S.run_available(bad, S.idempotent_sink(out_bad), f"{d}/ck2")
    assert spark.read.parquet(out_good).count() == 1
    errs = sorted(r.error for r in spark.read.parquet(out_bad).collect())
    assert errs == ["malformed event", "missing envelope field"]


def test_delimiter_sample_lines(spark):
    text = "\n".join(["a;b"] * 5 + ["x;y;z;w"] + [""])
    docs = spark.createDataFrame([(1, "\n" + text)], "id int, text string")
    lines = FS.text_lines(docs, "id", "text")
    assert FS.detect_delimiter(lines).first().delimiter == ","             # all lines: no consistent count
    assert FS.detect_delimiter(lines, sample_lines=5).first().delimiter == ";"   # first five non-empty lines


def test_malformed_rows_quarantine_and_salvage(spark):
    d = tempfile.mkdtemp(prefix="vt-bad-")
    open(f"{d}/b.csv", "w").write("1,2,3\n4,5,6\n7,8,9,10\n11,12,13\n")
    df = FS.read_delimited(spark, [f"{d}/b.csv"], ",", False, schema="a string, b string, c string")
    good, bad = FS.quarantine(df)
    assert sorted(r.a for r in good.collect()) == ["1", "11", "4"]
    assert [r.line for r in bad.collect()] == ["7,8,9,10"]             # over-long row kept whole
    salv = FS.salvage_split(spark, [f"{d}/b.csv"], ",", 4)
    rows = sorted((r.col_0, r.col_3) for r in salv.collect())
    assert rows == [("1", None), ("11", None), ("4", None), ("7", "10")]  # padded / full width


def test_salvage_keeps_overflow_and_refused_files_are_given(spark):
    from vetrina.plans.fixtures import RAW_PRODUCT_COLUMNS
    from vetrina.plans.q_files import scan_supplier_files
    d = tempfile.mkdtemp(prefix="vt-over-")
    os.mkdir(f"{d}/c0")
    open(f"{d}/c0/b.csv", "w").write("1,2\n7,8,9,10\n11\n")
    rows = {r.col_0: (r.col_1, r.overflow) for r in FS.salvage_split(spark, [f"{d}/c0/b.csv"], ",", 2).collect()}
    assert rows == {"1": ("2", []), "7": ("8", ["9", "10"]), "11": (None, [])}
    os.mkdir(f"{d}/c1")
    open(f"{d}/c0/b.csv", "w").write(";".join(RAW_PRODUCT_COLUMNS) + "\n" + ";".join("x" for _ in RAW_PRODUCT_COLUMNS) + "\n")
    open(f"{d}/c1/short.csv", "w").write("only a header")
    scanned, refused = scan_supplier_files(spark, d)
    assert scanned.count() == 1
    assert [(r.path.rsplit("/", 1)[1], r.errors) for r in refused.collect()] == [("short.csv", ["File must contain at least a header and one data row"])]


def test_admission_judges_whole_content(spark):
    """Late non-ASCII bytes, characters across old probe edges, long headers."""
    cases = {"late.csv": b"a;b\n" + b"x;y\n" * 4000 + "Müller;1\n".encode("latin-1"), "edge.csv": b"a\n" + b"x" * 1021 + "ü\n".encode(),
             "tail.csv": "a\nÃ".encode("latin-1"), "wide.csv": (";".join(f"column_{i}" for i in range(200)) + "\n1\n").encode()}
    rows = [(f"/x/{k}", len(v), None, bytearray(v)) for k, v in cases.items()]
    files = spark.createDataFrame(rows, "path string, length long, modificationTime timestamp, content binary")
    got = {r.path[3:]: (r.valid, r.encoding) for r in FS.admission(files).collect()}
    assert got == {"late.csv": (True, "iso-8859-1"), "edge.csv": (True, "utf-8"), "tail.csv": (True, "iso-8859-1"), "wide.csv": (True, "utf-8")}
    assert FS.admission(files, max_size=10).filter("valid").count() == 1


def test_status_folds_windows_of_a_job_past_midnight(spark):
    rows = [("c", "i", "mapping.applied", "2024-01-01 23:50:00"), ("c", "i", "file.received", "2024-01-02 00:05:00")]
    ev = spark.createDataFrame(rows, "client_id string, ingest_id string, event_type string, t string").selectExpr(
        "client_id", "ingest_id", "event_type", "cast(t as timestamp) as timestamp", "t as event_id", "'{}' as payload")
    assert S.job_status_stream(ev).count() == 2
    assert S.fold_job_status(S.job_status_stream(ev)).collect() == S.job_status_batch(ev).collect()
    late = ev.replace("mapping.applied", "file.received", "event_type")
    node = S.fold_latest_nodes(S.latest_nodes_stream(late)).collect()
    assert [(n.node_type, str(n.created_at)[:16], n.l.event_id) for n in node] == [("file", "2024-01-01 23:50", "2024-01-02 00:05:00")]
