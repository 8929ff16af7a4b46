"""S07 on real bytes: every row of a file is good, quarantined or salvaged."""

import pytest

from vetrina.sources import files as FS

COLUMNS = ["a", "b", "c"]
HEAD = "a;b;c\n"


@pytest.fixture()
def scan(spark, tmp_path):
    def run(files, **kw):
        folder = tmp_path / "with space"
        folder.mkdir(exist_ok=True)
        for name, text in files.items():
            (folder / name).write_bytes(text.encode(kw.get("encoding", "utf-8")))
        paths = [r.path for r in FS.discover(spark, str(folder)).select("path").collect()]
        out = FS.scan_with_quarantine(spark, paths, ";", COLUMNS, **kw)
        return {k: sorted((tuple(r[1:]) for r in df.collect()), key=repr) for k, df in out.items()}
    return run


def test_good_and_quarantined(scan):
    # an empty unquoted cell reads as null
    got = scan({"x.csv": HEAD + '1;2;3\nlong;"q;""x""";c;more;"last;one"\nshort;2\n"q;1";"say ""hi""";\n5" pipe;x;y\n'})
    assert got["good"] == [(0, "1", "2", "3"), (3, "q;1", 'say "hi"', None), (4, '5" pipe', "x", "y")]
    assert [r[2:] for r in got["quarantined"]] == [("too many cells", "long", 'q;"x"', "c", ["more", "last;one"]), ("too few cells", "short", "2", None, [])]
    assert got["quarantined"][0][:2] == (1, 'long;"q;""x""";c;more;"last;one"') and got["salvaged"] == []


def test_line_breaks_in_cells(scan):
    got = scan({"x.csv": HEAD + '1;"two\nlines";3\n4;"a\r\n\nb;""";6\nshort\n', "y.csv": HEAD + "7;8;9\n"})
    assert got["good"] == [(0, "1", "two\nlines", "3"), (0, "7", "8", "9"), (1, "4", 'a\n\nb;"', "6")] or got["good"] == [(0, "1", "two\nlines", "3"), (0, "7", "8", "9"), (1, "4", 'a\r\n\nb;"', "6")]
    assert [r[0] for r in got["quarantined"]] == [2] and got["salvaged"] == []


def test_quotes_that_never_close(scan):
    got = scan({"x.csv": HEAD + '1;"open;3\n4;5;6;7\n\n8\n', "y.csv": HEAD + "7;8;9\n"})
    assert got["salvaged"] == [(0, "1", '"open', "3", []), (1, "4", "5", "6", ["7"]), (2, "8", None, None, [])]
    assert got["good"] == [(0, "7", "8", "9")] and got["quarantined"] == []


def test_only_broken_files_and_no_header(scan):
    got = scan({"x.csv": '"open;b;c\n1;2;3\n'}, header=False)
    assert got["good"] == got["quarantined"] == [] and [r[0] for r in got["salvaged"]] == [0, 1]


def test_latin_text(scan):
    got = scan({"x.csv": HEAD + "é;ü;ß\nà\n"}, encoding="iso-8859-1")
    assert got["good"] == [(0, "é", "ü", "ß")] and got["quarantined"][0][1] == "à"


def test_row_numbers_over_splits(spark, tmp_path):
    rows = [f"{i};{'x' * 50};{i}" + (";more" if i % 10 == 3 else "") for i in range(5000)]
    (tmp_path / "x.csv").write_text(HEAD + "\n".join(rows) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        out = FS.scan_with_quarantine(spark, [str(tmp_path / "x.csv")], ";", COLUMNS)
        assert sorted((r.row_num, r.a) for r in out["good"].collect()) == [(i, str(i)) for i in range(5000) if i % 10 != 3]
        assert sorted((r.row_num, r.a, tuple(r.overflow)) for r in out["quarantined"].collect()) == [(i, str(i), ("more",)) for i in range(3, 5000, 10)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
