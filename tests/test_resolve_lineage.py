"""Properties: upsert idempotency, hot-GTIN blocking without pairs,
lookup join = literal map, min-depth walk vs all paths."""

import pytest
from pyspark.sql import functions as F

from vetrina.operators import lineage as L
from vetrina.operators import resolve as R
from vetrina.operators.mapping import FieldMapping, Template, apply_template, lookup_join

BATCH = ("client_id string, ingest_id string, row_num bigint, sku string, gtin string, product_name string, "
         "brand string, etim_class string, price string")


def test_upsert_idempotent(spark):
    rows = [("c", "i", 0, "A", "0001", "red bolt", "b", "EC1", "1.00"),
            ("c", "i", 1, "B", "0001", "red bolt", "b", "EC1", None),
            ("c", "i", 2, "A", None, None, None, None, "2.00"),
            ("c", "i", 3, "", "0002", "x", "b", "EC1", "3.00")]
    batch = spark.createDataFrame(rows, BATCH)
    res = R.resolve(batch)
    recs = res["records"]
    prods1 = R.upsert_products(recs)
    cw1 = R.upsert_crosswalk(recs)
    # second application of the same batch changes nothing
    rec2 = R.resolve(batch, prods1, cw1)["records"]
    prods2 = R.upsert_products(rec2, prods1)
    cw2 = R.upsert_crosswalk(rec2, cw1)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(prods1.drop("ingest_id")) == key(prods2.drop("ingest_id"))
    assert key(cw1) == key(cw2)
    actions = {r.sku: r.action for r in recs.collect()}
    assert actions == {"A": "created", "B": "merged"}       # same GTIN, score 1.0
    assert {r.sku: r.action for r in rec2.collect()} == {"A": "matched", "B": "matched"}
    a = [r for r in prods1.collect() if r.sku == "A"][0]
    assert a.price == "2.00" and a.gtin == "0001"            # last non-null per column
    assert res["failures"].count() == 1


def test_hot_gtin_compares_with_one_representative(spark):
    n = 2000
    rows = [("c", "i", i, f"S{i}", "0009", f"name {i % 7}", "b", "EC1", None) for i in range(n)]
    recs = R.resolve(spark.createDataFrame(rows, BATCH))["records"]
    assert recs.count() == n                                  # one record per SKU, no pair blow-up
    rep = [r for r in recs.collect() if r.first_row == 0][0]
    assert rep.action == "created" and rep.score is None


def test_lookup_join_matches_literal_map(spark):
    table = {"Steel": "ST", "STEEL": "S2", "brass": "BR"}
    df = spark.createDataFrame([(0, "Steel"), (1, "steel "), (2, "BRASS"), (3, "Ti")], "row_num long, M string")
    t = Template([FieldMapping("M", "m", "lookup", {"lookup_table": table})], [])
    lit_map = [r[0] for r in apply_template(df, t, keys=("row_num",)).orderBy("row_num").select("product.m").collect()]
    tdf = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(table.items())], "key string, value string, ordinal int")
    joined = [r[0] for r in lookup_join(df, "M", tdf, "m").orderBy("row_num").select("m").collect()]
    assert lit_map == joined == ["ST", "ST", "BR", "Ti"]


def test_walk_min_depth_and_all_paths(spark):
    # diamond: a -> b -> d, a -> c -> d, d -> e
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e")],
                                  "source_node_id string, target_node_id string")
    roots = spark.createDataFrame([("e", "e")], "root string, node_id string")
    up = {(r.node_id, r.depth) for r in L.walk(edges, roots, "up").collect()}
    assert up == {("d", 1), ("b", 2), ("c", 2), ("a", 3)}
    paths = [r.node_id for r in L.walk(edges, roots, "up", all_paths=True).collect()]
    assert sorted(paths) == ["a", "a", "b", "c", "d"]          # compat: one row per path
    down = {(r.node_id, r.depth) for r in L.walk(edges, spark.createDataFrame([("a", "a")], "root string, node_id string"), "down").collect()}
    assert down == {("b", 1), ("c", 1), ("d", 2), ("e", 3)}


def test_walk_depth_bound(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(15)],
                                  "source_node_id string, target_node_id string")
    roots = spark.createDataFrame([("n0", "n0")], "root string, node_id string")
    got = L.walk(chain, roots, "down", max_depth=10)
    assert got.agg(F.max("depth")).first()[0] == 10 and got.count() == 10
    whole = L.walk(chain, roots, "down")                       # no bound unless the caller gives one
    assert whole.agg(F.max("depth")).first()[0] == 15 and whole.count() == 15
    assert L.walk(chain, roots, "down", all_paths=True).count() == 10


def test_walk_ends_on_a_cycle(spark):
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "source_node_id string, target_node_id string")
    roots = spark.createDataFrame([("a", "a"), ("d", "d")], "root string, node_id string")
    assert {tuple(r) for r in L.walk(ring, roots, "down").collect()} == {("a", "b", 1), ("a", "c", 2), ("a", "d", 3)}


def test_walk_follows_trunks_without_an_aggregate(spark):
    edges = spark.createDataFrame([("o1", "c1"), ("o2", "c1"), ("o3", "c2"), ("c1", "n"), ("c2", "n"), ("n", "s1"), ("n", "s2"), ("n", "r"), ("s1", "t"), ("s2", "t")],
                                  "source_node_id string, target_node_id string")
    roots = spark.createDataFrame([("o1", "o1"), ("o2", "o2"), ("o2", "o2"), ("o3", "o3")], "root string, node_id string")
    got = L.walk(edges, roots, "down")
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    far = [("n", 2), ("s1", 3), ("s2", 3), ("r", 3), ("t", 4)]
    assert sorted(map(tuple, got.collect())) == sorted((o, *x) for o, c in (("o1", "c1"), ("o2", "c1"), ("o3", "c2")) for x in [(c, 1), *far])


def test_walk_equals_brute_force_on_random_graphs(spark):
    import random
    for seed in (1, 2):
        rnd = random.Random(seed)
        pairs = [(str(rnd.randrange(14)), str(rnd.randrange(14))) for _ in range(13 + 3 * seed)]  # rings, self loops, repeats
        starts = [(str(i), str(i)) for i in range(15)] + [("3", "5"), ("x", "2"), ("4", "4")]
        want = {}
        for root in {r for r, _ in starts}:
            depth, level = 0, {n for r, n in starts if r == root}
            seen = set(level)
            while level:
                depth, level = depth + 1, {b for a, b in pairs if a in level} - seen
                seen |= level
                want |= {(root, n): depth for n in level if n != root}
        got = L.walk(spark.createDataFrame(pairs, "source_node_id string, target_node_id string"), spark.createDataFrame(starts, "root string, node_id string"), "down").collect()
        own = {r for r, n in starts if r == n} - {"3"}
        rows = [((r.root, r.node_id), r.depth) for r in got]
        assert len(rows) == len(dict(rows)) and {k: d for k, d in rows if k[0] in own} == {k: d for k, d in want.items() if k[0] in own}


def test_walk_deals_a_hot_parting_node_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_NODES", 7)
    monkeypatch.setattr(L, "PIECE_ROWS", 100)
    edges = [(f"o{i}", f"c{i % 9}") for i in range(60)] + [(f"c{i}", "n") for i in range(9)] + [("n", f"s{i}") for i in range(40)] + [("n", "s0"), ("o1", "c1")]
    roots = [(f"o{i}", f"o{i}") for i in range(60)] * 2 + [("n", "n"), ("s1", "s1"), ("none", "none"), (None, None)]
    got = L.walk(spark.createDataFrame(edges, "source_node_id string, target_node_id string"), spark.createDataFrame(roots, "root string, node_id string"), "down")
    want = {(f"o{i}", f"c{i % 9}", 1) for i in range(60)} | {(f"o{i}", "n", 2) for i in range(60)} | {(f"o{i}", f"s{k}", 3) for i in range(60) for k in range(40)}
    assert sorted(map(tuple, got.collect())) == sorted(want | {("n", f"s{k}", 1) for k in range(40)})
    # rows are made from blocks, dealt by pieces: 61 roots x 40 rows in 25 pieces of about 100
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "inline(nodes" in plan and "RepartitionByExpression [at" in plan and "piece" in plan


def test_walk_does_not_trust_hashes(spark, monkeypatch):
    # all nodes share two hashes: ways part early, the rows are the same
    monkeypatch.setattr(L, "_hashed", lambda df, c: df.withColumn("hash", F.length(c).cast("long") % 2))
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "c"), ("c", "dd"), ("dd", "a"), ("dd", "e"), ("xx", "a"), ("f", "f"), ("f", "xx")],
                                  "source_node_id string, target_node_id string")
    roots = spark.createDataFrame([(x, x) for x in ("a", "b", "xx", "f", "e")], "root string, node_id string")
    tail = ["a", "b", "c", "dd", "e"]
    want = {("a", n, i) for i, n in enumerate(tail) if i} | {("b", "c", 1), ("b", "dd", 2), ("b", "a", 3), ("b", "e", 3)}
    want |= {("xx", n, i + 1) for i, n in enumerate(tail)} | {("f", "xx", 1)} | {("f", n, i + 2) for i, n in enumerate(tail)}
    assert sorted(map(tuple, L.walk(edges, roots, "down").collect())) == sorted(want)


def test_updated_since_is_not_ignored(spark):
    from vetrina.operators.export import export_filter
    rows = spark.createDataFrame([("p1", "active", "2024-01-01"), ("p2", "active", "2024-02-01")], "product_id string, status string, updated_at string")
    products = rows.withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    assert [r.product_id for r in export_filter(products, None, "global", updated_since="2024-01-15").collect()] == ["p2"]
    with pytest.raises(ValueError, match="updated_at"):
        export_filter(products.drop("updated_at"), None, "global", updated_since="2024-01-15")


def test_profile_sketch_mode_agrees_with_exact(spark):
    from vetrina.operators.profile import profile_columns
    rows = [(i, f"v{i % 37}", None if i % 5 == 0 else str(i * 1.5), "" if i % 7 == 0 else "x") for i in range(3000)]
    df = spark.createDataFrame(rows, "a long, b string, c string, d string")
    ex = {r.column: r for r in profile_columns(df).collect()}
    sk = {r.column: r for r in profile_columns(df, exact=False).collect()}
    for c in ex:
        for f in ("total_count", "null_count", "empty_count", "data_type_guess", "min_value", "max_value"):
            assert ex[c][f] == sk[c][f], (c, f)
        assert abs(sk[c].unique_count - ex[c].unique_count) <= 0.03 * ex[c].unique_count + 1
        if ex[c].mean_value is not None:
            assert abs(ex[c].mean_value - sk[c].mean_value) < 1e-6 * max(1.0, abs(ex[c].mean_value))
            assert abs(ex[c].std_value - sk[c].std_value) < 1e-6 * max(1.0, abs(ex[c].std_value))
    assert [t.value for t in sk["b"].top_values][:1] == [t.value for t in ex["b"].top_values][:1] or \
        sk["b"].top_values[0].cnt == ex["b"].top_values[0].cnt


def test_ingest_graph_and_retention(spark):
    import datetime as dt
    t = lambda d: dt.datetime(2024, 1, d)
    nodes = spark.createDataFrame(
        [("n1", "file", "c", "i1", t(1)), ("n2", "profile", "c", "i1", t(20)),
         ("n3", "file", "c", "i2", t(20)), ("n4", "product", "c", "i2", t(25))],
        "node_id string, node_type string, client_id string, ingest_id string, created_at timestamp")
    edges = spark.createDataFrame(
        [("e1", "n1", "n2", "processes", t(20)), ("e2", "n3", "n4", "generates", t(25)),
         ("e3", "n2", "n4", "derives_from", t(26)), ("e4", "n3", "n3", "self", t(26))],
        "edge_id string, source_node_id string, target_node_id string, edge_type string, created_at timestamp")
    n, e = L.ingest_graph(nodes, edges, "c", "i1")
    assert sorted(r.node_id for r in n.collect()) == ["n1", "n2"]
    assert sorted(r.edge_id for r in e.collect()) == ["e1", "e3"]     # touching by source OR target, once each
    kn, ke = L.retention(nodes, edges, "2024-01-31 00:00:00", days=15)
    assert sorted(r.node_id for r in kn.collect()) == ["n2", "n3", "n4"]
    # e1 is recent but its source n1 was dropped: a dangling edge goes too
    assert sorted(r.edge_id for r in ke.collect()) == ["e2", "e3", "e4"]


def test_arrival_order_across_ingests(spark):
    # row numbers start at 0 in each ingest: the later ingest wins, whatever the partitioning
    rows = [("c", "i1", 5, "A", None, "old", "b", "EC1", "1.00"), ("c", "i2", 0, "A", None, "new", "b", "EC1", None)]
    for parts in (1, 4):
        batch = spark.createDataFrame(rows[:: 1 if parts == 1 else -1], BATCH).repartition(parts)
        a = R.upsert_products(R.resolve(batch)["records"]).first()
        assert (a.product_name, a.price, a.ingest_id) == ("new", "1.00", "i2")


def test_third_of_gtins_missing_spreads(spark):
    rows = [("c", "i", i, f"S{i}", None if i % 3 == 0 else f"{i:08d}", f"name {i}", "b", "EC1", None) for i in range(300)]
    recs = R.resolve(spark.createDataFrame(rows, BATCH))["records"]
    assert recs.count() == 300 and recs.filter("action <> 'created' or score is not null").count() == 0


def test_profile_keeps_columns_of_one_name_apart(spark):
    from vetrina.operators.profile import profile_columns, structural_issues
    p = profile_columns(spark.createDataFrame([("1", "x"), ("2", "y")], "a string, b string").toDF("a", "a"))
    assert sorted((r.ordinal, r.data_type_guess, r.mean_6) for r in p.collect()) == [(0, "numeric", 1.5), (1, "string", None)]
    assert [(r.issue, r.measure) for r in structural_issues(p).collect()] == [("duplicate_names", 1.0)]
