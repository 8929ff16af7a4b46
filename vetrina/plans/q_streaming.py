"""Registered queries: streaming (S16, T01-T11) and their batch twins.

Events become pipeline envelopes: the user is the client, the event day the
ingest, the event kind a pipeline stage; the idempotency key is client,
stage and the event's minute.  Streaming queries write the envelopes as
JSON files into the shared checkpoint folder (one scan, several files per
slice of event time), drain them with ``availableNow`` into a batch-id sink,
and read the final state back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vetrina.plans.registry import register
from vetrina.session import scratch_path
from vetrina.sources.tables import table
from vetrina.streaming import events as S

AS_OF = "2024-01-31 00:00:00"
# Slices of event time are written one after another (the file source takes
# files by modification time); files of one slice come in any order, so the
# watermark waits for as long as a slice and nothing is lost.
SLICES = 8
FILES_PER_TRIGGER = 8
STAGE_OF = {"signup": "file.received", "view": "file.profiled", "click": "mapping.applied",
            "purchase": "validation.results", "error": "normalization.done"}


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    m = F.create_map(*[F.lit(x) for kv in STAGE_OF.items() for x in kv])
    stage = F.element_at(m, F.col("event_type"))
    client = F.col("user_id").cast("string")
    gate = F.when(F.col("value") >= 50, "PASS").when(F.col("value") >= 20, "WARN").otherwise("FAIL")
    payload = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"),
                                 F.when(stage == "validation.results", gate).alias("gate_status")))
    ts = F.col("ts").cast("timestamp")
    return e.select(
        F.col("event_id").cast("string").alias("event_id"), stage.alias("event_type"), ts.alias("timestamp"),
        F.concat(F.lit("trace-"), client).alias("trace_id"), client.alias("client_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("ingest_id"), F.lit("driver").alias("source_agent"),
        F.concat_ws("|", client, stage, F.date_format("ts", "yyyy-MM-dd HH:mm")).alias("idempotency_key"),
        payload.alias("payload"))


ENV_SQL = ("env AS (SELECT CAST(event_id AS VARCHAR) AS event_id, "
           "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STAGE_OF.items()) + " END AS event_type, "
           "ts AS timestamp, CAST(user_id AS VARCHAR) AS client_id, strftime(ts, '%Y-%m-%d') AS ingest_id, "
           "value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),"
           "env2 AS (SELECT *, client_id || '|' || event_type || '|' || strftime(timestamp, '%Y-%m-%d %H:%M') "
           "AS idempotency_key FROM env)")


def _stream_source(spark: SparkSession, sf_dir: str, chunks: int = SLICES, files: int | None = FILES_PER_TRIGGER) -> tuple[DataFrame, str]:
    """The envelope stream and its watermark delay.  Envelopes are split into
    ``chunks`` event-time slices in one scan; each slice is then written as
    JSON by several tasks, in the order of time (as files landing from live
    producers would)."""
    path = scratch_path(spark, "events-json")
    env = envelopes(spark, sf_dir)
    lo, hi = env.agg(F.min(F.unix_micros("timestamp")), F.max(F.unix_micros("timestamp"))).first()
    step = max(1, (hi - lo) // chunks + 1)
    slot = F.floor((F.unix_micros("timestamp") - F.lit(lo)) / F.lit(step))
    slices = scratch_path(spark, "event-slices")
    (env.withColumn("slot", slot).repartitionByRange(2 * chunks, "timestamp")
     .write.partitionBy("slot").parquet(slices))
    for i in range(chunks):
        part = spark.read.parquet(slices).filter(F.col("slot") == i).drop("slot")
        part.write.option("timestampFormat", S.TS_FORMAT).json(f"{path}/chunk={i:03d}")
    delay = f"{step // 1_000_000 + 60} seconds"
    good, _ = S.quarantine_split(S.read_events(spark, path, max_files_per_trigger=files))
    return good, delay


def _drain(spark: SparkSession, df: DataFrame, mode: str = "append", provider: str | None = None) -> DataFrame:
    out, key = scratch_path(spark, "stream-out"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    if provider:
        spark.conf.set(key, provider)
    try:
        S.run_available(df, S.idempotent_sink(out), scratch_path(spark, "stream-ckpt"), mode)
    finally:
        if provider:
            spark.conf.set(key, before) if before else spark.conf.unset(key)
    return spark.read.parquet(out)


def _last_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Final state of an update-mode stream: each key's last emitted row."""
    cols = [c for c in df.columns if c not in keys and c != "batch_id"]
    return df.groupBy(*keys).agg(*[F.max_by(c, "batch_id").alias(c) for c in cols])


@register("t01_typed_events", f"""WITH {ENV_SQL}
SELECT event_type, count(*) AS n_events, count(k) AS n_with_k FROM env2 GROUP BY ALL""")
def q_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelope stream parsed by type, quarantine split,
    micro-batches of a few files."""
    ev, _ = _stream_source(spark, sf_dir)
    t = S.typed(ev, {et: "k int, gate_status string" for et in STAGE_OF.values()})
    k = F.coalesce(*[F.col(f"p_{et.replace('.', '_')}.k") for et in STAGE_OF.values()])
    got = _drain(spark, t.select("event_type", k.alias("k")))
    return got.groupBy("event_type").agg(F.count("*").alias("n_events"), F.count("k").alias("n_with_k"))


@register("t02_dedup_stream", f"""WITH {ENV_SQL}
SELECT DISTINCT idempotency_key FROM env2""")
def q_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly one event per idempotency key (watermark dedup)."""
    ev, delay = _stream_source(spark, sf_dir)
    return _drain(spark, S.dedup(ev, delay).select("idempotency_key")).select("idempotency_key")


@register("t03_route_passing", f"""WITH {ENV_SQL}
SELECT event_id, client_id, ingest_id FROM env2 WHERE event_type = 'validation.results' AND value >= 20""")
def q_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only passing validation results go on to normalisation."""
    ev, _ = _stream_source(spark, sf_dir)
    return _drain(spark, S.route_to_normalization(ev).select("event_id", "client_id", "ingest_id")) \
        .select("event_id", "client_id", "ingest_id")


_STATUS_VALUES = ", ".join(f"('{a}', '{b}', {c})" for a, b, c in S.STATUS_AFTER)
STATUS_SQL = f"""WITH {ENV_SQL},
sm(event_type, status, rank) AS (VALUES {_STATUS_VALUES})
SELECT client_id, ingest_id, arg_max(status, (rank, timestamp)) AS status, max(timestamp) AS last_event
FROM env2 JOIN sm USING (event_type) GROUP BY ALL"""


@register("t08_job_status", STATUS_SQL)
def q_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T08 batch twin: job status per (client, ingest)."""
    s = S.job_status_batch(envelopes(spark, sf_dir))
    return s.withColumn("last_event", F.col("last_event").cast("timestamp_ntz"))


@register("t08_job_status_stream", STATUS_SQL)
def q_status_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T08 streaming: stateful aggregation with a watermark; the final
    state equals the batch twin."""
    ev, delay = _stream_source(spark, sf_dir)
    got = _drain(spark, S.job_status_stream(ev, delay).drop("w"), mode="update")
    return S.fold_job_status(got).withColumn(
        "last_event", F.col("last_event").cast("timestamp_ntz"))


_STUCK_SQL = f"""WITH {ENV_SQL},
sm(event_type, status, rank) AS (VALUES {_STATUS_VALUES}),
lim AS (SELECT (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) // {SLICES} + 1 AS step, epoch_us(max(timestamp)) AS hi FROM env2),
mark AS (SELECT hi // 1000 - (greatest(1, step) // 1000000 + 60) * 1000 AS wm FROM lim),
e AS (SELECT client_id, ingest_id, timestamp, coalesce(rank, -1) AS rank, status, lag(timestamp) OVER w AS before FROM env2 LEFT JOIN sm USING (event_type) WINDOW w AS (PARTITION BY client_id, ingest_id ORDER BY timestamp)),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR timestamp - before > INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY client_id, ingest_id ORDER BY timestamp RANGE UNBOUNDED PRECEDING) AS span FROM e),
j AS (SELECT client_id, ingest_id, span, arg_max(status, (rank, timestamp)) AS status, max(timestamp) AS last_event FROM s GROUP BY ALL)
SELECT client_id, ingest_id, status, last_event FROM j, mark
WHERE epoch_us(last_event) // 1000 + 3600000 <= wm AND (status IS NULL OR status NOT IN ({', '.join(f"'{t}'" for t in S.TERMINAL)}))"""


@register("t08_stuck_jobs", _STUCK_SQL)
def q_stuck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed state with event-time timers; a job idle for an hour of
    event time without having finished is reported once."""
    ev, delay = _stream_source(spark, sf_dir)
    got = _drain(spark, S.stuck_jobs(ev, delay=delay), provider=S.ROCKSDB)
    return got.select("client_id", "ingest_id", "status", F.col("last_event").cast("timestamp_ntz").alias("last_event"))


@register("t08_stuck_jobs_batch", _STUCK_SQL)
def q_stuck_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T08 batch twin: the same rows by session windows."""
    env = envelopes(spark, sf_dir)
    lo, hi = env.agg(F.min(F.unix_micros("timestamp")), F.max(F.unix_micros("timestamp"))).first()
    out = S.stuck_jobs_batch(env, delay=f"{max(1, (hi - lo) // SLICES + 1) // 1_000_000 + 60} seconds")
    return out.withColumn("last_event", F.col("last_event").cast("timestamp_ntz"))


@register("s16_keyed_sink", f"""WITH {ENV_SQL}
SELECT client_id || ':' || ingest_id AS key, event_id, event_type, row_number() OVER (PARTITION BY client_id, ingest_id ORDER BY timestamp, event_id) AS seq,
       'event_type=' || event_type || ',client_id=' || client_id || ',trace_id=trace-' || client_id AS headers FROM env2""")
def q_keyed_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events published as keyed records by a stream and read back; the
    records of a key come in the order of time."""
    ev, _ = _stream_source(spark, sf_dir, files=None)  # the files of a slice have no order, so they are published together
    out = scratch_path(spark, "keyed-out")
    S.run_available(ev, S.keyed_sink(out), scratch_path(spark, "stream-ckpt"))
    records = spark.read.parquet(out)
    value = F.from_json("value", S.ENVELOPE_DDL, {"timestampFormat": S.TS_FORMAT})
    place = Window.partitionBy("key").orderBy("batch_id", "offset")
    headers = F.array_join(F.transform("headers", lambda h: F.concat_ws("=", h["key"], h["value"])), ",")
    return records.withColumn("v", value).select("key", F.col("v.event_id").alias("event_id"), F.col("v.event_type").alias("event_type"),
                                                 F.row_number().over(place).cast("long").alias("seq"), headers.alias("headers"))


_FAILS = "CASE WHEN CAST(event_id AS BIGINT) % 11 = 3 THEN CAST(event_id AS BIGINT) % 6 ELSE 0 END"


@register("t05_dead_letters", f"""WITH {ENV_SQL},
b AS (SELECT *, CAST(event_id AS BIGINT) AS id, {_FAILS} AS fails FROM env2),
k AS (SELECT *, CASE WHEN id % 17 = 0 THEN 'malformed event' WHEN id % 19 = 0 THEN 'missing envelope field: client_id' WHEN fails > 3 THEN 'handler failed' END AS error FROM b)
SELECT event_id, CASE WHEN error IS NULL THEN 'done' ELSE 'dead' END AS sink, CASE WHEN id % 17 = 0 THEN NULL ELSE event_type END AS original_event_type, error,
       CAST(CASE WHEN id % 17 = 0 OR id % 19 = 0 THEN 1 WHEN error IS NULL THEN fails + 1 ELSE 4 END AS INTEGER) AS attempts FROM k""")
def q_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A handler that fails for some events (each as often as its id
    says), retried by the stream up to three times; broken lines, envelopes
    without a client and exhausted events end as dead letters."""
    src, done, dead = (scratch_path(spark, n) for n in ("attempts", "attempts-done", "attempts-dead"))
    env = envelopes(spark, sf_dir).withColumn("id", F.col("event_id").cast("long"))
    env = env.withColumn("client_id", F.when((F.col("id") % 19 == 0) & (F.col("id") % 17 != 0), F.lit(None)).otherwise(F.col("client_id")))
    line = F.to_json(F.struct(*S.ENVELOPE_COLUMNS), {"timestampFormat": S.TS_FORMAT})
    env.select(F.when(F.col("id") % 17 == 0, F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line).alias("value")).write.text(f"{src}/first")

    def handler(df: DataFrame) -> DataFrame:
        fails = F.expr(_FAILS)
        return df.withColumn("error", F.when(F.col("attempts") < fails, "handler failed"))

    state = scratch_path(spark, "stream-ckpt")
    stream = S.read_attempts(spark, f"{src}/*")
    for _ in range(4):  # first attempts, then what each run sent back
        S.run_available(stream, S.retrying(handler, done, src, dead), state)
    letters = spark.read.parquet(dead).select(F.coalesce("event_id", F.regexp_extract("original", r'"event_id":"(\d+)"', 1)).alias("event_id"), F.lit("dead").alias("sink"),
                                              "original_event_type", "error", "attempts")
    fine = spark.read.parquet(done).select("event_id", F.lit("done").alias("sink"), F.col("event_type").alias("original_event_type"), F.lit(None).cast("string").alias("error"), "attempts")
    return letters.unionByName(fine)


@register("t09_milestones", f"""WITH {ENV_SQL}
SELECT 'lineage-' || ingest_id || '-' || event_type AS event_id, client_id, ingest_id, event_type AS milestone
FROM env2 WHERE event_type IN ({', '.join(f"'{m}'" for m in S.MILESTONES)})""")
def q_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage-updated events for significant milestones."""
    return S.milestones(envelopes(spark, sf_dir)).select("event_id", "client_id", "ingest_id", "milestone")


def _latency_sql() -> str:
    firsts = ",\n  ".join(f"min(timestamp) FILTER (WHERE event_type = '{s}') AS \"{s}\"" for s in S.STAGE_ORDER)
    diffs = ",\n  ".join(
        f"CAST(floor(epoch(\"{b}\")) AS BIGINT) - CAST(floor(epoch(\"{a}\")) AS BIGINT) AS s_{a.split('.')[0]}_to_{b.split('.')[0]}"
        for a, b in zip(S.STAGE_ORDER, S.STAGE_ORDER[1:]))
    return f"""WITH {ENV_SQL},
p AS (SELECT client_id, ingest_id,
  {firsts}
  FROM env2 GROUP BY ALL)
SELECT client_id, ingest_id,
  {diffs}
FROM p"""


@register("t10_stage_latency", _latency_sql())
def q_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T10 batch: seconds between consecutive stages of each job."""
    return S.stage_latency(envelopes(spark, sf_dir))


@register("t10_throughput_stream", f"""WITH {ENV_SQL}
SELECT time_bucket(INTERVAL 1 HOUR, timestamp) AS window_start, event_type, count(*) AS n_events
FROM env2 GROUP BY ALL""")
def q_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T10 streaming: events per stage per hour (update mode, final state)."""
    ev, delay = _stream_source(spark, sf_dir)
    got = _drain(spark, S.throughput_stream(ev, delay=delay).select(F.col("w.start").alias("window_start"), "event_type",
                                                       "n_events"), mode="update")
    return _last_per_key(got, ["window_start", "event_type"]).withColumn(
        "window_start", F.col("window_start").cast("timestamp_ntz"))


@register("t11_topic_retention", f"""WITH {ENV_SQL}
SELECT event_type, count(*) AS n_kept FROM env2
WHERE timestamp >= TIMESTAMP '{AS_OF}' - to_days(CAST(CASE event_type
  {' '.join(f"WHEN '{k}' THEN {v}" for k, v in S.TOPIC_RETENTION_DAYS.items())} ELSE 7 END AS INTEGER))
GROUP BY ALL""")
def q_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-topic retention (7 or 30 days before ``as_of``)."""
    return S.apply_retention(envelopes(spark, sf_dir), AS_OF).groupBy("event_type").agg(
        F.count("*").alias("n_kept"))


@register("t07_latest_nodes_stream", f"""WITH {ENV_SQL},
n AS (SELECT client_id, ingest_id, CASE event_type
        {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in S.NODE_TYPES.items())} ELSE 'unknown' END AS node_type,
        timestamp, event_id FROM env2)
SELECT client_id, ingest_id, node_type, min(timestamp) AS created_at, max(timestamp) AS updated_at,
       CAST(arg_max(CAST(event_id AS BIGINT), (timestamp, event_id)) AS VARCHAR) AS last_event_id
FROM n GROUP BY ALL""")
def q_latest_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest node per (client, ingest, type) as streaming state (the
    twin of G03); the final state is read back from the batch-id sink."""
    ev, delay = _stream_source(spark, sf_dir)
    got = _drain(spark, S.latest_nodes_stream(ev, delay).drop("w"), mode="update")
    last = S.fold_latest_nodes(got).select("*", F.col("l.timestamp").alias("updated_at"), F.col("l.event_id").alias("last_event_id"))
    return last.select("client_id", "ingest_id", "node_type",
                       F.col("created_at").cast("timestamp_ntz").alias("created_at"),
                       F.col("updated_at").cast("timestamp_ntz").alias("updated_at"), "last_event_id")
