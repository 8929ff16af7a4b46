"""Registered queries: lineage.

Two graphs are derived from the driver tables:

* the key graph region -> nation -> customer -> order and supplier ->
  nation (node ids prefixed by type) for the ancestor / impact walks;
* the pipeline graph from ``events``: the user is the client, the event
  day the ingest, and the five event kinds stand for five pipeline stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetrina.operators import lineage as L
from vetrina.plans.q_resolve import RESOLVE_SQL, first_import
from vetrina.plans.registry import register
from vetrina.session import materialize
from vetrina.sources.tables import table

AS_OF = "2024-03-01 00:00:00"
STAGE_OF = {"signup": "file.received", "view": "file.profiled", "click": "mapping.applied",
            "purchase": "validation.results", "error": "normalization.done"}


def key_graph(spark: SparkSession, sf_dir: str):
    t = lambda n: table(spark, sf_dir, n)
    nid = lambda p, c: F.concat(F.lit(p + ":"), F.col(c).cast("string"))
    nodes = (t("region").select(nid("region", "r_regionkey").alias("node_id"), F.lit("region").alias("node_type"))
             .unionByName(t("nation").select(nid("nation", "n_nationkey").alias("node_id"), F.lit("nation").alias("node_type")))
             .unionByName(t("customer").select(nid("customer", "c_custkey").alias("node_id"), F.lit("customer").alias("node_type")))
             .unionByName(t("orders").select(nid("order", "o_orderkey").alias("node_id"), F.lit("order").alias("node_type")))
             .unionByName(t("supplier").select(nid("supplier", "s_suppkey").alias("node_id"), F.lit("supplier").alias("node_type"))))
    e = lambda df, s, sc, d, dc: df.select(nid(s, sc).alias("source_node_id"), nid(d, dc).alias("target_node_id"))
    edges = (e(t("nation"), "region", "n_regionkey", "nation", "n_nationkey")
             .unionByName(e(t("customer"), "nation", "c_nationkey", "customer", "c_custkey"))
             .unionByName(e(t("orders"), "customer", "o_custkey", "order", "o_orderkey"))
             .unionByName(e(t("supplier"), "supplier", "s_suppkey", "nation", "s_nationkey")))
    return nodes, edges


KEY_GRAPH_SQL = """nodes AS (
  SELECT 'region:' || r_regionkey AS node_id, 'region' AS node_type FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation' FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'customer' FROM customer
  UNION ALL SELECT 'order:' || o_orderkey, 'order' FROM orders
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier' FROM supplier),
edges AS (
  SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer
  UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier)"""


@register("g01_ancestors", f"""WITH RECURSIVE {KEY_GRAPH_SQL},
up(root, node_id, depth) AS (
  SELECT node_id, node_id, 0 FROM nodes WHERE node_type = 'order'
  UNION ALL
  SELECT up.root, e.src, up.depth + 1 FROM up JOIN edges e ON e.dst = up.node_id WHERE up.depth < 10)
SELECT root, node_id, CAST(min(depth) AS INTEGER) AS depth FROM up WHERE depth > 0 GROUP BY root, node_id""")
def q_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's ancestors at their minimum depth (<= 10)."""
    nodes, edges = key_graph(spark, sf_dir)
    roots = nodes.filter(F.col("node_type") == "order").select(F.col("node_id").alias("root"), "node_id")
    return L.walk(edges, roots, "up").withColumn("depth", F.col("depth").cast("int"))


@register("g02_impact_summary", f"""WITH RECURSIVE {KEY_GRAPH_SQL},
down(root, node_id, depth) AS (
  SELECT node_id, node_id, 0 FROM nodes WHERE node_type = 'region'
  UNION ALL
  SELECT down.root, e.dst, down.depth + 1 FROM down JOIN edges e ON e.src = down.node_id WHERE down.depth < 10),
reach AS (SELECT DISTINCT root, node_id FROM down WHERE depth > 0)
SELECT reach.root, n.node_type, count(*) AS n_nodes FROM reach JOIN nodes n ON n.node_id = reach.node_id
GROUP BY ALL""")
def q_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downstream impact of every region, counted by type."""
    nodes, edges = key_graph(spark, sf_dir)
    roots = nodes.filter(F.col("node_type") == "region").select(F.col("node_id").alias("root"), "node_id")
    return L.impact_summary(L.walk(edges, roots, "down"), nodes)


# --------------------------------------------------------------------------
# Pipeline graph from events.
# --------------------------------------------------------------------------
def pipeline_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.create_map(*[F.lit(x) for kv in STAGE_OF.items() for x in kv])
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"),
                    F.col("user_id").cast("string").alias("client_id"),
                    F.date_format("ts", "yyyy-MM-dd").alias("ingest_id"),
                    F.element_at(m, F.col("event_type")).alias("event_type"),
                    F.col("props").alias("payload"))


def pipeline_graph(spark: SparkSession, sf_dir: str):
    """Nodes are one row per (client, ingest, stage): far smaller than the
    events and read several times (both edge ends, filters), so they are
    materialised once instead of re-aggregating the events per use."""
    ev = pipeline_events(spark, sf_dir)
    nodes = materialize(L.derive_nodes(ev), "lineage-nodes")
    return nodes, L.derive_edges(nodes, ev), ev


_STAGE_CASE = ("CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STAGE_OF.items()) + " END")
_NODE_CASE = ("CASE stage " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.EVENT_NODE_TYPES.items())
              + " ELSE 'unknown' END")
PIPE_SQL = f"""ev AS (SELECT event_id, ts, CAST(user_id AS VARCHAR) AS client_id, strftime(ts, '%Y-%m-%d') AS ingest_id,
                   {_STAGE_CASE} AS stage, props AS payload FROM events),
evn AS (SELECT *, {_NODE_CASE} AS node_type FROM ev),
pnodes AS (
  SELECT sha256(client_id || '|' || ingest_id || '|' || node_type) AS node_id, node_type, client_id, ingest_id,
         node_type || ':' || ingest_id AS entity_id,
         arg_max(payload, (ts, event_id)) AS metadata, min(ts) AS created_at, max(ts) AS updated_at
  FROM evn GROUP BY client_id, ingest_id, node_type),
rules(stage, source_type, edge_type) AS (VALUES
  {', '.join(f"('{a}', '{b}', '{c}')" for a, b, c in L.EDGE_RULES)}),
pev AS (SELECT evn.client_id, evn.ingest_id, rules.source_type, evn.node_type AS target_type, rules.edge_type,
               min(evn.ts) AS created_at
        FROM evn JOIN rules ON evn.stage = rules.stage GROUP BY ALL),
pedges AS (
  SELECT DISTINCT s.node_id AS source_node_id, t.node_id AS target_node_id, pev.edge_type, pev.created_at
  FROM pev JOIN pnodes s ON s.client_id = pev.client_id AND s.ingest_id = pev.ingest_id AND s.node_type = pev.source_type
           JOIN pnodes t ON t.client_id = pev.client_id AND t.ingest_id = pev.ingest_id AND t.node_type = pev.target_type)"""


@register("g03_nodes_from_events", f"""WITH {PIPE_SQL}
SELECT node_id, node_type, client_id, ingest_id, entity_id, metadata, created_at, updated_at FROM pnodes""")
def q_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One node per (client, ingest, stage), latest metadata wins."""
    n = L.derive_nodes(pipeline_events(spark, sf_dir))
    return n.withColumn("created_at", F.col("created_at").cast("timestamp_ntz")) \
            .withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


@register("g04_edges_from_events", f"""WITH {PIPE_SQL}
SELECT source_node_id, target_node_id, edge_type, created_at FROM pedges""")
def q_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage -> next-stage edges within each (client, ingest)."""
    _, e, _ = pipeline_graph(spark, sf_dir)
    return e.select("source_node_id", "target_node_id", "edge_type",
                    F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@register("g05_file_product_edges", f"""{RESOLVE_SQL}
SELECT sha256(client_id || '|' || ingest_id || '|file') AS source_node_id, 'product:' || product_id AS target_node_id,
       'generates' AS edge_type, count(*) AS n_rows
FROM r GROUP BY ALL""")
def q_file_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File node -> product node per imported record."""
    rec = first_import(spark, sf_dir)["records"]
    return (rec.select(L.node_id(F.col("client_id"), F.col("ingest_id"), F.lit("file")).alias("source_node_id"),
                       F.concat(F.lit("product:"), "product_id").alias("target_node_id"),
                       F.lit("generates").alias("edge_type"))
            .groupBy("source_node_id", "target_node_id", "edge_type").agg(F.count("*").alias("n_rows")))


@register("g06_ingest_graph", f"""WITH {PIPE_SQL},
ids AS (SELECT node_id FROM pnodes WHERE client_id = '1' AND ingest_id = '2024-01-02')
SELECT source_node_id, target_node_id, edge_type FROM pedges
WHERE source_node_id IN (SELECT node_id FROM ids) OR target_node_id IN (SELECT node_id FROM ids)""")
def q_ingest_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ingest's nodes and every edge touching them."""
    nodes, edges, _ = pipeline_graph(spark, sf_dir)
    _, e = L.ingest_graph(nodes, edges, "1", "2024-01-02")
    return e.select("source_node_id", "target_node_id", "edge_type")


@register("g07_retention", f"""WITH {PIPE_SQL},
kn AS (SELECT * FROM pnodes WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 45 DAY),
ke AS (SELECT * FROM pedges WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 45 DAY
         AND source_node_id IN (SELECT node_id FROM kn) AND target_node_id IN (SELECT node_id FROM kn))
SELECT 'node' AS kind, node_type AS type, count(*) AS n FROM kn GROUP BY ALL
UNION ALL SELECT 'edge', edge_type, count(*) FROM ke GROUP BY ALL""")
def q_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retention window of 45 days before ``as_of``; dangling edges
    are dropped with the nodes."""
    nodes, edges, _ = pipeline_graph(spark, sf_dir)
    kn, ke = L.retention(nodes, edges, AS_OF, 45)
    return (kn.groupBy(F.lit("node").alias("kind"), F.col("node_type").alias("type")).agg(F.count("*").alias("n"))
            .unionByName(ke.groupBy(F.lit("edge").alias("kind"), F.col("edge_type").alias("type"))
                         .agg(F.count("*").alias("n"))))


@register("a20_node_counts", f"""WITH {PIPE_SQL}
SELECT node_type, count(*) AS n_nodes FROM pnodes GROUP BY ALL""")
def q_node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by type."""
    return L.node_counts(pipeline_graph(spark, sf_dir)[0])


@register("a21_edge_counts", f"""WITH {PIPE_SQL}
SELECT s.client_id, e.edge_type, count(*) AS n_edges
FROM pedges e JOIN pnodes s ON s.node_id = e.source_node_id GROUP BY ALL""")
def q_edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by type per client (joined to the source node)."""
    nodes, edges, _ = pipeline_graph(spark, sf_dir)
    return L.edge_counts(nodes, edges)


@register("a22_activity_per_day", f"""WITH {PIPE_SQL}
SELECT CAST(created_at AS DATE) AS day, count(*) AS n_nodes FROM pnodes
WHERE created_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 DAY
GROUP BY ALL ORDER BY day DESC LIMIT 30""")
def q_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes created per day in the last 30 days."""
    return L.activity_per_day(pipeline_graph(spark, sf_dir)[0], "2024-01-31 00:00:00", 30)
