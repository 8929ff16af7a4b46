"""Similar products without a blocking key against all pairs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from vetrina.operators import similar as S


def brute(records):
    out = set()
    groups = {}
    for cls, name, brand in records:
        words = frozenset((name or "").lower().split())
        groups.setdefault((cls, words, brand.lower() if brand else brand), []).append((cls, name, brand))
    for a, b in itertools.combinations(groups, 2):
        if not a[0] or a[0] != b[0] or not a[1] or not b[1]:
            continue
        j = lambda x, y: len(x & y) / len(x | y) if x and y else 0.0
        brand = 0.0 if not a[2] or not b[2] else 1.0 if a[2] == b[2] else j(set(a[2].split()), set(b[2].split()))
        if 0.4 * j(a[1], b[1]) + 0.3 * brand + 0.3 >= 0.8 - 1e-12:
            out.add(frozenset([a, b]))
    return out


def links(spark, records):
    df = spark.createDataFrame(records, "etim_class string, product_name string, brand string").repartition(4)
    groups = S.product_groups(df).cache()
    key = {r.group_id: (r.etim_class, frozenset(r.name_words or []), r.brand.lower() if r.brand else r.brand) for r in groups.collect()}
    assert sum(r.n_records for r in groups.collect()) == len(records)
    found = S.similar_groups(groups).collect()
    assert all(r.a_group_id < r.b_group_id and r.score >= 0.8 for r in found)
    pairs = [frozenset([key[r.a_group_id], key[r.b_group_id]]) for r in found]
    assert len(pairs) == len(set(pairs))
    return set(pairs)


def test_all_pairs_are_found(spark):
    draw = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    records = [(draw.choice(["EC1", "EC2", None, ""]), " ".join(draw.sample(words[: draw.choice([8, 30])], draw.randint(1, 6))), draw.choice(["Acme", "ACME", "Acme Ltd", "Other", None])) for _ in range(500)]
    records += records[:50] + [("EC1", None, "Acme"), ("EC1", "", "Acme"), ("EC1", "   ", None), ("EC1", "W1 w1 W2", "acme"), ("EC1", "w2  w1", "Acme")]
    assert links(spark, records) == brute(records)


@pytest.mark.parametrize("levels", [0, 2])
def test_hot_bands_are_split(spark, monkeypatch, levels):
    """All groups share most words: bands are split, then compared in blocks."""
    monkeypatch.setattr(S, "SMALL", 8)
    monkeypatch.setattr(S, "BLOCK", 16)
    monkeypatch.setattr(S, "LEVELS", levels)
    records = [("EC1", f"steel bolt long hex v{i} x{i % 9}", "b") for i in range(90)]
    assert links(spark, records) == brute(records)


def test_recall_and_limits(spark):
    assert S.miss_probability(0.5) < 1.1e-4
    groups = S.product_groups(spark.createDataFrame([], "etim_class string, product_name string, brand string"))
    assert S.similar_groups(groups).count() == 0
    with pytest.raises(ValueError):
        S.similar_groups(groups, threshold=0.7)
    assert groups.select(F.count("*")).first()[0] == 0


def test_bands_keep_to_brands(spark, monkeypatch):
    """Brands without a common word never link, so their products do not crowd
    one band; brands that share words still meet, whatever their length."""
    made, real = [], S.materialize
    monkeypatch.setattr(S, "materialize", lambda df, name: made.append(name) or real(df, name))
    monkeypatch.setattr(S, "SMALL", 8)
    records = [("EC1", f"name{i} kind{i} part{i}", f"brand{j}") for i in range(4) for j in range(12)]
    assert links(spark, records) == brute(records)
    assert "bands-1" not in made
    brands = ["A B", "b a", "a", "a b c", "a b c d", "a b c d e", "x a b c d", "c", ""]
    records = [("EC1", name, b) for b in brands for name in ("u v w x", "u v w y", "u v w", "u v")]
    assert links(spark, records) == brute(records)
