"""Lineage graph.

Nodes and edges are two DataFrames.  Upstream / downstream queries walk
many roots at once, breadth first, until nothing new is found.  The default
walk shares work between roots with a common first hop; the compat walk
keeps one row per path.  Edges and levels are written to the shared folder,
so a lost executor reads a level again instead of repeating the walk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetrina.session import materialize
from vetrina.sources.tables import local_rows

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference.
# ---------------------------------------------------------------------------
EVENT_NODE_TYPES = {
    "file.received": "file",
    "file.profiled": "profile",
    "mapping.applied": "mapping",
    "validation.results": "validation",
    "normalization.done": "normalization",
    "persistence.upserted": "product",
    "export.completed": "export",
}
# (event type, source node type, edge type): the edge created when an event
# of that type arrives, from the latest node of the source type.
EDGE_RULES = [
    ("file.profiled", "file", "processes"),
    ("mapping.applied", "profile", "processes"),
    ("validation.results", "mapping", "processes"),
    ("normalization.done", "validation", "processes"),
    ("persistence.upserted", "normalization", "generates"),
    ("export.completed", "product", "derives_from"),
]
COMPAT_DEPTH = 10
RETENTION_DAYS = 90

# Nodes in a block of a walk, and rows that one copy of the blocks makes.
BLOCK_NODES = 1000
PIECE_ROWS = 20_000_000


def node_id(client, ingest, node_type):
    return F.sha2(F.concat_ws("|", client, ingest, node_type), 256)


def derive_nodes(events: DataFrame) -> DataFrame:
    """One node per (client, ingest, node type); the latest event's
    metadata wins (``max_by`` on the timestamp, event id as tie-break)."""
    m = F.create_map(*[F.lit(x) for kv in EVENT_NODE_TYPES.items() for x in kv])
    e = events.withColumn("node_type", F.coalesce(F.element_at(m, F.col("event_type")), F.lit("unknown")))
    latest = e.groupBy("client_id", "ingest_id", "node_type").agg(
        F.max_by(F.struct("ts", "event_id", "payload"), F.struct("ts", "event_id")).alias("l"),
        F.min("ts").alias("created_at"))
    return latest.select(
        node_id(F.col("client_id"), F.col("ingest_id"), F.col("node_type")).alias("node_id"),
        "node_type", "client_id", "ingest_id",
        F.concat_ws(":", "node_type", "ingest_id").alias("entity_id"),
        F.col("l.payload").alias("metadata"), "created_at",
        F.col("l.ts").alias("updated_at"))


def derive_edges(nodes: DataFrame, events: DataFrame) -> DataFrame:
    """For each event with an edge rule, an edge from the node of the
    rule's source type to the event's node, in the same (client, ingest);
    deduplicated on (source, target, type)."""
    spark = nodes.sparkSession
    rules = local_rows(spark, EDGE_RULES, "event_type string, source_type string, edge_type string")
    m = F.create_map(*[F.lit(x) for kv in EVENT_NODE_TYPES.items() for x in kv])
    ev = (events.join(F.broadcast(rules), "event_type")
          .select("client_id", "ingest_id", "source_type", "edge_type",
                  F.element_at(m, F.col("event_type")).alias("target_type"), "ts")
          .groupBy("client_id", "ingest_id", "source_type", "target_type", "edge_type")
          .agg(F.min("ts").alias("created_at")))
    src = nodes.select(F.col("node_id").alias("source_node_id"), "client_id", "ingest_id",
                       F.col("node_type").alias("source_type"))
    tgt = nodes.select(F.col("node_id").alias("target_node_id"), "client_id", "ingest_id",
                       F.col("node_type").alias("target_type"))
    e = (ev.join(src, ["client_id", "ingest_id", "source_type"])
           .join(tgt, ["client_id", "ingest_id", "target_type"]))
    return (e.select(F.sha2(F.concat_ws("|", "source_node_id", "target_node_id", "edge_type"), 256).alias("edge_id"),
                     "source_node_id", "target_node_id", "edge_type", "created_at")
            .dropDuplicates(["source_node_id", "target_node_id", "edge_type"]))


def walk(edges: DataFrame, roots: DataFrame, direction: str = "up", max_depth: int | None = None,
         all_paths: bool = False) -> DataFrame:
    """G01/G02 (J09/J10): nodes reachable from each root, within
    ``max_depth`` levels if that is given.

    ``roots``: (root, node_id).  ``up`` follows target -> source (ancestors),
    ``down`` source -> target (descendants).  Default: one row per (root,
    node) at its minimum depth, until no new node is found; cycles end since
    a node is visited once.  ``all_paths`` (compat) keeps one row per path
    like the reference's ``UNION ALL`` recursion, ``COMPAT_DEPTH`` levels
    deep.

    A root with one next node is followed to where ways part (order ->
    customer -> nation), once per *distinct* next node; from there the walk
    runs once per distinct parting node and is joined back at the end, in
    blocks of nodes.  That join is the root x ancestor expansion; no row of
    it is met twice, so nothing is aggregated.  Roots with other or several
    starts, and a bounded walk, go by their first hops."""
    frm, to = ("target_node_id", "source_node_id") if direction == "up" else ("source_node_id", "target_node_id")
    e = materialize(edges.select(F.col(frm).alias("node_id"), F.col(to).alias("next_id")), "walk-edges")
    if all_paths:
        return _levels(e, roots, COMPAT_DEPTH if max_depth is None else max_depth, True)
    if max_depth is not None:
        return _by_first_hop(e, roots, max_depth)
    if not roots.agg(F.bool_or(F.col("root") != F.col("node_id"))).first()[0]:
        return _by_trunks(e, roots.where("root = node_id").select("node_id"))
    odd = materialize(roots.where("root <> node_id").select("root").distinct(), "walk-odd")
    own = roots.where("root = node_id").join(odd, "root", "left_anti").select("node_id")
    return _by_trunks(e, own).unionByName(_by_first_hop(e, roots.join(odd, "root", "left_semi")))


def _by_trunks(e: DataFrame, own: DataFrame) -> DataFrame:
    """The walk of roots that are their own only start: the nodes of their
    trunks, and what lies beyond the node where ways part.

    What lies beyond is kept as blocks of about ``BLOCK_NODES`` nodes, so a
    root meets few rows in the join and rows are made from whole blocks.
    Roots of a parting node are dealt to pieces that make about
    ``PIECE_ROWS`` rows each, and the blocks are repeated for every piece,
    so no task makes all rows of a hot node."""
    e = _hashed(e.where("node_id <> next_id"), "node_id")
    # nodes with one edge have a hash of their own; one that shares its hash may count as parting, which changes no row
    several = materialize(e.groupBy("hash").agg(F.count("*").alias("n"), F.min(F.xxhash64("next_id")).alias("lo"), F.max(F.xxhash64("next_id")).alias("hi"))
                          .where("n > 1").select("hash", (F.col("lo") == F.col("hi")).alias("again")), "walk-several")
    again = (e.join(several.where("again"), "hash", "left_semi").groupBy("hash", "node_id")
             .agg(F.min("next_id").alias("next_id"), F.max("next_id").alias("last")).where("next_id = last").drop("last"))
    only = e.join(several, "hash", "left_anti").unionByName(again)
    own = _hashed(own, "node_id")
    first = materialize(
        only.join(own, ["hash", "node_id"], "left_semi").select("node_id", "next_id")
        .unionByName(own.join(several, "hash", "left_semi").join(again, ["hash", "node_id"], "left_anti").select("node_id").distinct(), True), "walk-first")
    on, parted = first.where("next_id is not null"), first.where("next_id is null").select(F.col("node_id").alias("at"))
    hops = materialize(on.groupBy(F.col("next_id").alias("start")).agg(F.count("*").alias("n_roots")), "walk-hops")
    chains = _chains(only, several, hops.select("start"))
    parting = materialize(chains.where("parts").join(hops, "start").select("at", "n_roots").unionByName(parted.withColumn("n_roots", F.lit(1)))
                          .groupBy("at").agg(F.sum("n_roots").alias("n_roots")), "walk-parting")
    far = materialize(_by_first_hop(e, parting.select(F.col("at").alias("root"), F.col("at").alias("node_id")))
                      .select(F.col("root").alias("at"), "node_id", F.col("depth").alias("more")), "walk-far")
    # nodes of a trunk can be met again only where its end is on a ring
    ring = far.join(e, "node_id").where(F.col("next_id") == F.col("at")).select("at", F.lit(True).alias("ring")).distinct()
    sizes = materialize(
        far.groupBy("at").agg(F.count("*").alias("n")).join(parting, "at").join(ring, "at", "left")
        .select("at", F.coalesce("ring", F.lit(False)).alias("ring"), F.ceil(F.col("n") / BLOCK_NODES).alias("blocks"),
                (F.col("n") * F.col("n_roots")).alias("rows"), F.expr(f"cast(ceil(n * n_roots / {PIECE_ROWS}) as int)").alias("pieces")), "walk-sizes")
    # a root that its chain comes back to ends the trunk
    back = F.expr("cast(array_position(seen, root) as int)")
    trunks = materialize(
        _hashed(on.select(F.col("node_id").alias("root"), F.col("next_id").alias("start")), "start")
        .join(_hashed(chains.join(sizes.select("at", "pieces"), "at", "left"), "start"), ["hash", "start"])
        .select("root", F.when(back > 0, F.slice("seen", F.lit(1), back - 1)).otherwise(F.col("seen")).alias("seen"),
                F.when(F.col("parts"), F.col("at")).alias("at"), F.expr("cast(pmod(xxhash64(root), pieces) as int)").alias("piece"))
        .unionByName(parted.select(F.col("at").alias("root"), F.expr("cast(array() as array<string>)").alias("seen"), "at", F.lit(0).alias("piece"))), "walk-trunks")
    out = trunks.select("root", F.posexplode("seen").alias("pos", "node_id")).select("root", "node_id", (F.col("pos") + 1).alias("depth"))
    rows, ring = sizes.agg(F.sum("rows"), F.bool_or("ring")).first()
    if not rows:
        return out
    blocks = materialize(
        far.join(sizes, "at").groupBy("at", "ring", "pieces", F.expr("pmod(xxhash64(node_id), blocks)").alias("block"))
        .agg(F.collect_list(F.struct("node_id", "more")).alias("nodes"))
        .select("at", F.explode(F.expr("sequence(0, pieces - 1)")).alias("piece"), "ring", "nodes"), "walk-blocks")
    # files of repeated blocks are small, so Spark would broadcast what takes far more memory
    deal = [max(int(e.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // PIECE_ROWS)), "at", "piece"]
    meet = lambda t, b: t.repartition(*deal).join(b.repartition(*deal).hint("merge"), ["at", "piece"])
    depth, trunks = (F.col("steps") + F.col("more")).alias("depth"), trunks.where("at is not null").withColumn("steps", F.size("seen"))
    out = out.unionByName(meet(trunks.drop("seen"), blocks.where("not ring").drop("ring"))
                          .select("root", "steps", F.inline("nodes")).select("root", "node_id", depth))
    if not ring:
        return out
    return out.unionByName(meet(trunks, blocks.where("ring").drop("ring")).select("root", "seen", "steps", F.inline("nodes"))
                           .where("root <> node_id and not array_contains(seen, node_id)").select("root", "node_id", depth))


def _hashed(df: DataFrame, column: str) -> DataFrame:
    """With a hash of the column, which goes before it in join keys: ids that
    begin alike are slow to sort, their hashes are not."""
    return df.withColumn("hash", F.xxhash64(column))


def _chains(only: DataFrame, several: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, at, seen, parts): distinct starts followed along ``only``, the
    edges of nodes that have one, until ways part or end: the last node, and
    all nodes from start to it."""
    now, chains = starts.select("start", F.col("start").alias("at"), F.array("start").alias("seen")), None
    nodes = starts.select(F.col("start").alias("node_id"))
    while True:
        met = only.join(_hashed(nodes, "node_id"), ["hash", "node_id"], "left_semi").select("hash", F.col("node_id").alias("at"), "next_id")
        step = materialize(
            _hashed(now, "at").join(met, ["hash", "at"], "left").join(several.select("hash", F.lit(True).alias("several")), "hash", "left")
            .select("start", "at", "seen", "next_id", F.expr("next_id is not null and not array_contains(seen, next_id)").alias("goes_on"),
                    F.expr("next_id is null and several is not null").alias("parts")), "walk-chain")
        done = step.where("not goes_on").select("start", "at", "seen", "parts")
        chains = done if chains is None else chains.unionByName(done)
        now = step.where("goes_on").select("start", F.col("next_id").alias("at"), F.concat("seen", F.array("next_id")).alias("seen"))
        if now.isEmpty():
            return chains
        nodes = materialize(now.select(F.col("at").alias("node_id")).distinct(), "walk-ends")


def _by_first_hop(e: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """dist(r, a) = 1 + min over first hops p of dist(p, a), with dist(p, p) =
    0.  The first hop is taken per root; the rest of the walk runs once per
    *distinct* first-hop node and is joined back at the end."""
    hop = materialize(roots.join(e, "node_id").select("root", F.col("next_id").alias("node_id"))
                      .filter(F.col("root") != F.col("node_id")).distinct(), "walk-hop")
    first = hop.withColumn("depth", F.lit(1))
    if max_depth is not None and max_depth <= 1:
        return first
    starts = hop.select(F.col("node_id").alias("root"), "node_id").distinct()
    rest = _levels(e, starts, None if max_depth is None else max_depth - 1, False)
    via = (hop.alias("h").join(rest.alias("s"), F.col("h.node_id") == F.col("s.root"))
           .select(F.col("h.root").alias("root"), F.col("s.node_id").alias("node_id"),
                   (F.col("s.depth") + 1).alias("depth"))
           .filter(F.col("root") != F.col("node_id")))
    return (first.unionByName(via).groupBy("root", "node_id")
            .agg(F.min("depth").cast("int").alias("depth")))


def _levels(e: DataFrame, roots: DataFrame, max_depth: int | None, all_paths: bool) -> DataFrame:
    """Breadth-first walk per root.  Each level is a written table, so a
    lost executor reads it again and nothing stays cached."""
    frontier = roots.select("root", "node_id", F.lit(0).alias("depth"))
    none = found = frontier.where(F.lit(False))
    start, level = roots.select("root", "node_id"), 0
    while max_depth is None or level < max_depth:
        level += 1
        step = frontier.join(e, "node_id").select("root", F.col("next_id").alias("node_id"),
                                                  F.lit(level).alias("depth"))
        if not all_paths:
            visited = start.unionByName(found.select("root", "node_id"))
            step = step.distinct().join(visited, ["root", "node_id"], "left_anti")
        frontier = materialize(step, "walk-level")
        if frontier.isEmpty():
            break
        found = frontier if found is none else found.unionByName(frontier)
    return found


def impact_summary(descendants: DataFrame, nodes: DataFrame) -> DataFrame:
    """Downstream node counts by type, per root."""
    return (descendants.join(nodes.select("node_id", "node_type"), "node_id")
            .groupBy("root", "node_type").agg(F.count("*").alias("n_nodes")))


def ingest_graph(nodes: DataFrame, edges: DataFrame, client_id, ingest_id) -> tuple[DataFrame, DataFrame]:
    """Nodes of one ingest and every edge touching any of them.

    The reference's ``source = ANY(ids) OR target = ANY(ids)`` becomes two
    semi-joins (no nested loop) and a union deduplicated on edge_id."""
    n = nodes.filter((F.col("client_id") == client_id) & (F.col("ingest_id") == ingest_id))
    ids = n.select("node_id")
    by_src = edges.join(ids.withColumnRenamed("node_id", "source_node_id"), "source_node_id", "left_semi")
    by_tgt = edges.join(ids.withColumnRenamed("node_id", "target_node_id"), "target_node_id", "left_semi")
    return n, by_src.unionByName(by_tgt).dropDuplicates(["edge_id"])


def retention(nodes: DataFrame, edges: DataFrame, as_of, days: int = RETENTION_DAYS):
    """Drop edges, then nodes, older than ``days`` before ``as_of``;
    edges left dangling by removed nodes go too (semi-joins on both ends)."""
    cut = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    keep_nodes = nodes.filter(F.col("created_at") >= cut)
    ids = keep_nodes.select("node_id")
    keep_edges = (edges.filter(F.col("created_at") >= cut)
                  .join(ids.withColumnRenamed("node_id", "source_node_id"), "source_node_id", "left_semi")
                  .join(ids.withColumnRenamed("node_id", "target_node_id"), "target_node_id", "left_semi"))
    return keep_nodes, keep_edges


def node_counts(nodes: DataFrame) -> DataFrame:
    """A20."""
    return nodes.groupBy("node_type").agg(F.count("*").alias("n_nodes"))


def edge_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges by type, joined to their source node (for the client)."""
    src = nodes.select(F.col("node_id").alias("source_node_id"), "client_id")
    return (edges.join(src, "source_node_id").groupBy("client_id", "edge_type")
            .agg(F.count("*").alias("n_edges")))


def activity_per_day(nodes: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Nodes created per day over the last ``days`` days, newest first."""
    lo = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    return (nodes.filter(F.col("created_at") >= lo)
            .groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n_nodes"))
            .orderBy(F.col("day").desc()))
