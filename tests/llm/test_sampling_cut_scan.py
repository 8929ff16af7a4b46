"""Operators 11 (sampling), 12 (fill in middle) and 13 (secret scan) against brute force, with nulls, empty and long texts,
ties, repeated rows, empty tables and clashing columns."""

import base64
import bz2
import gzip
import hashlib
import math
import re
import urllib.parse
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SMALL
from vetrina.llm import fill_in_middle, secret_scan, target_sampling
from vetrina.llm.queries import QUERIES

SECRET = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'
LONG = "x" * 3000 + " é" * 40 + "\nline two <P\n" + "word " * 6000
TEXTS = [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc\n"), (3, None), (4, ""), (5, "\n\n\n"), (6, "one <S> two\nthree"), (None, "no id\nhere"), (7, LONG), (8, LONG), (8, "other text\nof one id"),
         (9, "Ünï\n\r\n😀 code\npoints"), (10, "alpha beta Gamma " * 30), (11, "ALPHA beta gamma " * 30), (12, SECRET), (13, "no line end")]


@pytest.fixture(scope="module")
def docs(spark):
    clash = "doc_id long, text string, form string, rank int, spans string, n_words int"
    return spark.createDataFrame([(i, t, "c", 1, "c", 2) for i, t in TEXTS], clash).repartition(3).cache()


def same(got, want):
    assert sorted(got, key=repr) == sorted(want, key=repr)


# fill in middle

def brute_cut(doc_id, text):
    t = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", t)
    d = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")):
        return doc_id, len(lines), "plain", None, None, t
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    form = "spm" if h[3] % 100 < 50 else "psm"
    return doc_id, len(lines), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def test_fill_in_middle(docs):
    out = fill_in_middle.fill_in_middle(docs)
    same([tuple(r) for r in out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()], [brute_cut(*r) for r in TEXTS])
    assert out.columns == ["doc_id", "rank", "spans", "n_words", *fill_in_middle.RESULT]
    back = out.select("doc_id", fill_in_middle.restored(F.col("output"), F.col("form")))
    same([tuple(r) for r in back.collect()], [(i, t or "") for i, t in TEXTS])


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("a\né😀 "), max_size=60), st.integers(1, 9))
def test_block_tree(text, block):
    tree = fill_in_middle.BlockTree(text.encode(), block)
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    assert tree.lines == len(lines)
    for k in range(len(lines) + 1):
        head = "".join(lines[:k])
        assert tree.after(k) == (len(head.encode()), len(head))


# importance resampling

def brute_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_buckets(text):
    w = brute_words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.text(st.sampled_from("aB c1é.\n"), max_size=40), st.text(max_size=10), st.integers(60, 400).map(lambda n: "q" * n + " r")), max_size=8))
def test_features(texts):
    words = target_sampling.Words(pa.array(texts, pa.string()))
    got = [[] for _ in texts]
    for rows, places in words.runs(3, 10000):
        for i, b in zip(rows.tolist(), places.tolist()):
            got[i].append(b)
    assert got == [brute_buckets(t) for t in texts]


@pytest.mark.parametrize("size", [0, 1, 3, 63, 64, 65, 127, 128, 129, 1000, 70_001])
def test_crc_of_any_length(size):
    data = np.random.default_rng(size).integers(0, 256, size + 7).astype(np.uint8)
    assert target_sampling.crc32_of(data, np.array([3]), np.array([3 + size])).tolist() == [zlib.crc32(data[3 : 3 + size].tobytes())] if size else True


def brute_resample(texts, target, percent):
    s, t = Counter(b for _, x in texts for b in brute_buckets(x)), Counter(b for x in target for b in brute_buckets(x))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + 10000) / ((s[b] + 1) * (n_t + 10000)))) for b in range(10000)]
    rows = []
    for i, x in texts:
        own = brute_buckets(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(brute_words(x)) >= 20])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in rows]


@pytest.mark.parametrize("percent", [5, 50, 100])
def test_importance_resample(spark, docs, percent):
    target = ["beta gamma word", None, "", "word word word"]
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    out = target_sampling.importance_resample(docs, bench, percent=percent)
    same([tuple(r) for r in out.collect()], brute_resample(TEXTS, target, percent))


def test_resample_ranges_are_joined(spark, monkeypatch):
    """Ranks run on over many ranges, repeated rows included; no target text
    and no document are fine."""
    monkeypatch.setattr(target_sampling, "RANGE_ROWS", 10)
    texts = [(i % 150, f"w{i % 7} " * 25) for i in range(300)] + [(0, "w1 " * 25)] * 150
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    none = spark.createDataFrame([], "text string")
    out = [tuple(r) for r in target_sampling.importance_resample(df, none, percent=60).collect()]
    same([(i, n, w, s) for i, n, w, s, _ in out], [r[:4] for r in brute_resample(texts, [], 60)])
    assert sorted(r[4] for r in out if r[4]) == list(range(1, 271))
    ranked = sorted((r for r in out if r[4]), key=lambda r: r[4])
    assert ranked == sorted(ranked, key=lambda r: (-r[3], r[0], r[4]))
    assert target_sampling.importance_resample(df.where("false"), df).count() == 0


# secret scan

def brute_base(text):
    """Straight from the definition: match, then drop."""
    found = []
    for k, (name, pattern) in enumerate({"assign": r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}.items()):
        for m in re.finditer(pattern, text, re.I | re.A if name == "assign" else re.A):
            if {"assign": lambda: len(m[2]) >= 12, "access": lambda: len(m[0]) >= 18, "hex": lambda: len(m[0]) >= 16}[name]():
                found.append((m.start(), k, m.end()))
    return sorted(found)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "PassWd", "toKen", "ſecret", "ToKen", "api_key", "APIKEY", "secret", "AKIA", "AKIAABCDEFGHIJKLMN", "é", " ", "=", ": ", '"', "'", "abcdef0123456789", "0123456789abcdef" * 2, "x", "/", "\n", "😀"]), max_size=14).map("".join))
def test_base_spans(text):
    base, spans, *_ = secret_scan.scan(text)
    assert base == brute_base(text) and set(base) <= set(spans)


WRAPS = {"url": lambda b: urllib.parse.quote_from_bytes(b, safe="").encode(), "all_url": lambda b: b"".join(b"%%%02x" % c for c in b), "b64": base64.b64encode, "b64url": lambda b: base64.urlsafe_b64encode(b).rstrip(b"="),
         "unicode": lambda b: b"".join(b"\\u%04x" % c for c in b), "html": lambda b: b"".join(b"&#%d;" % c for c in b), "gzip": lambda b: base64.b64encode(gzip.compress(b)), "zlib": lambda b: base64.b64encode(zlib.compress(b)),
         "bz2": lambda b: base64.b64encode(bz2.compress(b)), "zstd": lambda b: base64.b64encode(zstandard.compress(b)), "wide": lambda b: base64.b64encode(b.decode("latin-1").encode("utf-16-le"))}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(sorted(WRAPS)), max_size=4), st.sampled_from(["", "é see: ", "path/to/", "x "]), st.sampled_from(["", " end", "\n"]))
def test_nested_layers(order, before, after):
    """A secret behind any nesting is found, and its span is in the wrapped part."""
    data = SECRET.encode()
    for name in order:
        data = WRAPS[name](data)
    text = before + data.decode() + after
    _, spans, _, unopened = secret_scan.scan(text)
    inside = [(a, k, b) for a, k, b in spans if len(before) <= a < b <= len(text) - len(after)]
    assert {0, 2} <= {k for _, k, _ in inside} and not unopened
    wide = max((b - a for a, k, b in inside if k == 0), default=0)
    assert wide >= min(len(data) - 8, 49)


def test_spans_are_exact():
    inner = base64.b64encode(b"user:1 " + SECRET.encode() + b" rest").decode()
    _, spans, layers, _ = secret_scan.scan("é " + inner + " tail")
    (a, b), = [(a, b) for a, k, b in spans if k == 0]
    assert 2 + 7 * 8 // 6 == a and b == 2 + (56 * 8 - 1) // 6 + 1 and layers == 1
    _, spans, _, _ = secret_scan.scan("token%3Dabcdefghijkl%41 x")
    assert spans == [(0, 0, 23)]
    wrapped = base64.encodebytes((SECRET + "\n").encode() * 4).decode()
    assert sum(k == 0 for _, k, _ in secret_scan.scan(wrapped)[1]) == 4


def test_fixpoint_and_bombs():
    loop = "Vm0wd2QyUXlVWGxWV0d4V1YwZDRWMVl3WkRSV01WbDNXa1JTVjAxV2JETlhhMUpUVmpBeFYySkVUbGhoTVVwVVZtcEJlRll5U2tWVWJHaG9UVlZ3VlZadGNFSmxSbGw1VTJ0V1ZXSkhhRzlVVmxaM1ZsWmFkR05GU214U2JHdzFWVEowVjFaWFNraGhSemxWVm14YU0xWnNXbUZrUjA1R1drWndWMDFFUlRGV1ZFb3dWakZhV0ZOcmFHaFNlbXhXVm0xNFlVMHhXbk5YYlVaclVqQTFSMWRyV25kV01ERkZVbFJHVjFaRmIzZFdha1poVjBaT2NtRkhhRk5sYlhoWFZtMXdUMVF3TUhoalJscFlZbFZhY2xWcVFURlNNWEJHVjIxR2FGWnNiRFZhVldNMVlWWktjMk5HYUZkTlJsWTBWbTF3UjFsV1pISk9WbHBYWWtkb1dGWnRNVk5qUm14VlUyMDVVMkpIVW5sV1YzTTFWVEpLUjJOSVJsWk5ha1p5V1ZkNFMxWnJNVVZSYkZab1RXNW9kbGRzWkhkU01XUnpZMFp3V0dFeGNITldiWGhoVjBaV2RWRnRPVmROUkVaWVZsYzFTMVp0UmpaV2JYQldWbTE0Y2xkcldtRlRWVFZYV2tkb2FGTkZTbFZYVmxKTFZURlplRmRZYUZaaVJrcFlWbXBPVW1Wc1duRlJiVVpUVFZkNGVsWXhhSGRXTURGWFkwWm9WMkpVUm5aWlZWVjRWakZhZFZKc2NGZE5NVXBaVm14U1MxSXhXblJTYmxaWVlrWktjRlpxVG05WFZscDBUVlZrVTAxWFVucFdNalZMVjBkS1NGVnRPVlppVkVWNlZqQmFZV1JGTVZsaFIyeE9WbXhyZDFkV1ZtOWtNVnAwVTJ0a1dHSkhhR2hXYlRGdlpXeHJlV1ZIT1ZkTmEzQklWakowTUZVeVNraFBWa0pYWVd0YWNWUnJXbXRqTVdSMFVteFNhVkl6YUZGV1YzaHJUa1paZUZkdVRsZGlWVnBZVm1wT1UyRkdXWGxPVm1oVllYcEdXRlp0Y0ZOV01ERnhWbXRvVjJKVVJYcFpWV1JMVWpKT1IxcEhhRTVXTURSNldYcEdZVlpYU2toVmJuQllZWHBXV0ZadGVHRlhSbHAwWlVkR1dHSkhVbnBYYTFwVFZqRmFkR1JJVGxOaVIzaFhWbTF3UzFKdFZraFZiR2hvVFVSR1dGWnRjRmRXTURGWFkwWm9WMDFHV2xoV01uaGhWMFphZEdWR1dsaGlSbHA2VjFod1MxWnRSWGhXYkdoWFRVWmFXRll5ZUdGWFJscDBaVVphV0dKR1duQlhhMXBUVmpGYWRHUklUbE5pUjNoWFZtMXdTMUp0Vmtobg=="
    secret_scan.scan(loop * 3)
    bomb = base64.b64encode(gzip.compress(b"0" * 3_000_000 + b" " + SECRET.encode())).decode()
    assert any(k == 0 for _, k, _ in secret_scan.scan(bomb)[1])
    assert secret_scan.scan(bomb + " " + SECRET, max_bytes=1000)[3] > 0 and secret_scan.scan(bomb + " " + SECRET, max_bytes=1000)[0]


def test_scan_secrets(docs):
    out = secret_scan.scan_secrets(docs)
    assert out.columns == [c for c in docs.columns if c != "spans"] + list(secret_scan.RESULT)
    name = lambda spans: [(secret_scan.KINDS[k], a, b) for a, k, b in spans]
    same([(r.doc_id, r.text, [tuple(s) for s in r.base], [tuple(s) for s in r.spans]) for r in out.collect()], [(i, t, name(brute_base(t or "")), name(brute_base(t or ""))) for i, t in TEXTS])
    assert secret_scan.scan_secrets(docs.where("false")).count() == 0


BASE_SQL = r"""
WITH p AS (SELECT * FROM (VALUES (1, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
                                 (2, 'access', 'AKIA[A-Z0-9]+'), (3, 'hex', '[0-9a-f]+')) AS v(k, kind, re)),
     m AS (SELECT doc_id, k, kind, re, regexp_extract_all(coalesce(text, ''), re) AS hit, regexp_split_to_array(coalesce(text, ''), re) AS gap FROM documents, p),
     s AS (SELECT doc_id, k, kind, re, unnest(hit) AS hit, unnest(range(1, len(hit) + 1)) AS i, gap, hit AS hits FROM m WHERE len(hit) > 0),
     a AS (SELECT doc_id, k, kind, hit, re, length(array_to_string(gap[1:i], '')) + length(array_to_string(hits[1:i - 1], '')) AS b FROM s),
     f AS (SELECT doc_id, k, kind, b, b + length(hit) AS e FROM a WHERE CASE k WHEN 1 THEN length(regexp_extract(hit, re, 2)) >= 12 WHEN 2 THEN length(hit) >= 18 ELSE length(hit) >= 16 END)
SELECT d.doc_id, count(*) FILTER (k = 1) AS n_assign, count(*) FILTER (k = 2) AS n_access, count(*) FILTER (k = 3) AS n_hex,
       sha256(coalesce(string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, k), '')) AS base_sha256
FROM documents d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id"""


def test_base_spans_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SMALL}/documents.parquet')")
    out = QUERIES["op13_secret_scan"](spark, SMALL)
    same([tuple(r) for r in out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect()], con.sql(BASE_SQL).fetchall())
    assert out.schema.simpleString() == "struct<doc_id:bigint,n_assign:bigint,n_access:bigint,n_hex:bigint,base_sha256:string,spans:string,n_layers:bigint,n_unopened:bigint>"
