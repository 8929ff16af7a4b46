"""Structured Streaming for the event-driven parts.

The reference consumes one message at a time from a broker.  Here an event
stream is a streaming DataFrame of envelopes (JSON files in development; a
Kafka source has the same columns once its connector is on the classpath),
and every stateful step has a watermark or a state timeout so keys do not
grow without bound.  Each streaming operator has a batch twin that gives
the same rows on a static DataFrame; tests compare the two.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from vetrina.operators.lineage import EVENT_NODE_TYPES as NODE_TYPES
from vetrina.sources.tables import local_rows

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference.
# ---------------------------------------------------------------------------
ENVELOPE_DDL = ("event_id string, event_type string, timestamp timestamp, trace_id string, "
                "client_id string, ingest_id string, source_agent string, idempotency_key string, "
                "payload string")
ENVELOPE_COLUMNS = [c.split()[0] for c in ENVELOPE_DDL.split(", ")]
TOPIC_RETENTION_DAYS = {
    "file.received": 7, "file.profiled": 7, "mapping.applied": 7, "validation.results": 7,
    "normalization.done": 7, "persistence.upserted": 30, "export.requested": 7,
    "export.completed": 30, "dq.report.ready": 30, "lineage.updated": 30,
    "processing.error": 30, "job.status.updated": 7,
}
MILESTONES = ["file.profiled", "validation.results", "persistence.upserted", "export.completed"]
# Job status reached when an event of this type is seen, with its rank in
# the status machine (a failure outranks everything).
STATUS_AFTER = [
    ("file.received", "profiling", 1), ("file.profiled", "mapping", 2),
    ("mapping.applied", "validating", 3), ("validation.results", "normalizing", 4),
    ("normalization.done", "executing", 5), ("persistence.upserted", "completed", 6),
    ("processing.error", "failed", 9),
]
TERMINAL = ("completed", "failed", "cancelled")
PASSING_GATES = ("PASS", "WARN")
# Envelope timestamps keep microseconds on the wire.
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
STAGE_ORDER = ["file.received", "file.profiled", "mapping.applied", "validation.results",
               "normalization.done", "persistence.upserted"]


def read_events(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Envelope stream from JSON files.  Malformed lines land
    in ``_corrupt`` (PERMISSIVE) for the quarantine split."""
    r = (spark.readStream.schema(ENVELOPE_DDL + ", _corrupt string").option("mode", "PERMISSIVE")
         .option("columnNameOfCorruptRecord", "_corrupt").option("timestampFormat", TS_FORMAT))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.json(path)


def typed(events: DataFrame, payload_schemas: dict[str, str] | None = None) -> DataFrame:
    """Parse each payload by its event type; unknown types keep the
    payload as a variant (``try_parse_json``) and the base envelope."""
    out = events.withColumn("payload_v", F.try_parse_json("payload"))
    for et, ddl in (payload_schemas or {}).items():
        out = out.withColumn(f"p_{et.replace('.', '_')}",
                             F.when(F.col("event_type") == et, F.from_json("payload", ddl)))
    return out


def quarantine_split(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine).  A line that did not parse, or an envelope
    without its keys, goes to quarantine with the error and original type
    (the error-event shape); good rows go on."""
    bad = (F.col("_corrupt").isNotNull() | F.col("client_id").isNull() | F.col("ingest_id").isNull()
           | F.col("event_type").isNull())
    err = (F.when(F.col("_corrupt").isNotNull(), F.lit("malformed event"))
            .otherwise(F.lit("missing envelope field")))
    q = events.filter(bad).select(F.col("event_type").alias("original_event_type"), "client_id", "ingest_id",
                                  err.alias("error"), F.coalesce("_corrupt", F.to_json(F.struct("*"))).alias("original"))
    return events.filter(~bad).drop("_corrupt"), q


def dedup(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Idempotent consumption -- one event per idempotency key within
    the watermark delay (state for a key expires with the watermark)."""
    return events.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["idempotency_key"])


def route_to_normalization(events: DataFrame) -> DataFrame:
    """Only validation results whose gate passed (PASS / WARN)."""
    gate = F.get_json_object("payload", "$.gate_status")
    return events.filter((F.col("event_type") == "validation.results") & gate.isin(*PASSING_GATES))


def idempotent_sink(path: str, partition_col: str = "batch_id"):
    """A ``foreachBatch`` writer that overwrites its own batch folder,
    so a batch replayed after a failure replaces, never duplicates."""
    def write(df: DataFrame, batch_id: int):
        (df.withColumn(partition_col, F.lit(batch_id)).write.mode("overwrite")
         .parquet(f"{path}/{partition_col}={batch_id}"))
    return write


def run_available(df: DataFrame, sink, checkpoint: str, output_mode: str = "append"):
    """Drain everything available now (tests / catch-up runs).  A service
    uses ``trigger(processingTime='30 seconds')`` instead (T06)."""
    q = (df.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint)
         .foreachBatch(sink).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def status_map(spark: SparkSession) -> DataFrame:
    return local_rows(spark, STATUS_AFTER, "event_type string, status string, rank int")


def job_status_batch(events: DataFrame) -> DataFrame:
    """T08 batch twin: per (client, ingest) the status of the highest-ranked
    event (latest wins among equal ranks)."""
    s = events.join(F.broadcast(status_map(events.sparkSession)), "event_type")
    return s.groupBy("client_id", "ingest_id").agg(
        F.max_by("status", F.struct("rank", "timestamp")).alias("status"),
        F.max("timestamp").alias("last_event"))


def job_status_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """T08 streaming: the best status so far per (client, ingest, day window),
    kept in the state store and evicted by the watermark.  The sink folds the
    windows of a job with ``fold_job_status``, so a job that runs past
    midnight has the status of the batch twin."""
    s = events.join(F.broadcast(status_map(events.sparkSession)), "event_type")
    return (s.withWatermark("timestamp", delay)
            .groupBy("client_id", "ingest_id", F.window("timestamp", "1 day").alias("w"))
            .agg(F.max(F.struct("rank", "timestamp", "status")).alias("best"),
                 F.max("timestamp").alias("last_event")))


def fold_job_status(emitted: DataFrame) -> DataFrame:
    """One row per (client, ingest) from all rows a status stream emitted:
    a maximum, so neither batches nor replays change it."""
    return emitted.groupBy("client_id", "ingest_id").agg(
        F.max("best")["status"].alias("status"), F.max("last_event").alias("last_event"))


STUCK_SCHEMA = "client_id string, ingest_id string, status string, last_event timestamp"
JOB_BUCKETS = 512
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ranked(events: DataFrame) -> DataFrame:
    """Events with the status and rank of their type (null and -1 for others)."""
    s = events.join(F.broadcast(status_map(events.sparkSession)), "event_type", "left")
    return s.select("client_id", "ingest_id", "timestamp", "status", F.coalesce("rank", F.lit(-1)).alias("rank"))


def merge_spans(spans: list[tuple], gap: int) -> list[tuple]:
    """Spans (start, end, rank, at, status) that follow one another within
    ``gap`` become one, with the status of the highest (rank, at)."""
    out: list[tuple] = []
    for start, end, rank, at, status in sorted(spans, key=lambda s: s[:2]):
        if out and start - out[-1][1] <= gap:
            a = out[-1]
            best = max((a[2], a[3], a[4] or ""), (rank, at, status or ""))
            out[-1] = (a[0], max(a[1], end), best[0], best[1], best[2] or None)
        else:
            out.append((start, end, rank, at, status))
    return out


def fold_spans(spans: pd.DataFrame, gap: int) -> pd.DataFrame:
    """``merge_spans`` for the spans of many jobs at once, on whole columns."""
    spans = spans.sort_values(["client_id", "ingest_id", "start"], kind="stable", ignore_index=True)
    job = spans.groupby(["client_id", "ingest_id"], sort=False).ngroup()
    reached = spans["end"].groupby(job).cummax()
    begins = (job != job.shift()) | (spans["start"] - reached.shift(fill_value=0) > gap)
    run = begins.cumsum()
    best = spans.assign(run=run).sort_values(["run", "rank", "at"], kind="stable").drop_duplicates("run", keep="last").drop(columns="run").reset_index(drop=True)
    return best.assign(start=spans["start"].groupby(run).min().to_numpy(), end=spans["end"].groupby(run).max().to_numpy())


class JobWatch(StatefulProcessor):
    """Per bucket of jobs the spans of activity that event time has not closed
    yet.  A span closes when the watermark has passed its last event by the
    idle time; if its status is not terminal, the job is reported stuck.  What
    is reported depends on event times alone, not on batches: spans merge as
    events come in any order within the watermark's delay.  A bucket's timer
    stands at the first time that one of its spans can close."""

    COLUMNS = ["client_id", "ingest_id", "start", "end", "rank", "at", "status"]

    def __init__(self, idle_ms: int):
        self.idle = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.spans = handle.getListState("spans", "client_id string, ingest_id string, start long, end long, rank int, at long, status string")

    def _held(self) -> pd.DataFrame:
        return pd.DataFrame([tuple(s) for s in self.spans.get()] if self.spans.exists() else [], columns=self.COLUMNS)

    def _keep(self, spans: pd.DataFrame) -> None:
        if len(spans):
            self.spans.put(list(zip(*[spans[c].tolist() for c in self.COLUMNS], strict=True)))
        else:
            self.spans.clear()

    def _due(self, spans: pd.DataFrame) -> pd.Series:
        return spans["end"].astype("int64") // 1000 + self.idle

    def handleInputRows(self, key, rows, timerValues):
        old = self._held()
        parts = [old] if len(old) else []
        for pdf in rows:  # an event is a span of its own; close ones become one
            at = pdf["timestamp"].to_numpy("datetime64[us]").astype("int64")
            new = pd.DataFrame({"client_id": pdf["client_id"], "ingest_id": pdf["ingest_id"], "start": at, "end": at, "rank": pdf["rank"], "at": at, "status": pdf["status"].astype(object).where(pdf["status"].notna(), None)})
            parts.append(fold_spans(new, self.idle * 1000))
        spans = fold_spans(pd.concat(parts, ignore_index=True), self.idle * 1000)
        first = int(self._due(spans).min())
        if len(old) and (before := int(self._due(old).min())) != first:
            self.handle.deleteTimer(before)
        if not len(old) or before != first:
            self.handle.registerTimer(first)
        self._keep(spans)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        spans = self._held()
        # all that the watermark has passed, not only the span of the timer
        upto = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        closed = self._due(spans) <= upto
        left = spans[~closed]
        self._keep(left)
        if len(left):
            self.handle.registerTimer(int(self._due(left).min()))
        stuck = spans[closed & ~spans["status"].isin(TERMINAL)]
        if len(stuck):
            yield pd.DataFrame({"client_id": stuck["client_id"], "ingest_id": stuck["ingest_id"], "status": stuck["status"],
                                "last_event": pd.to_datetime(stuck["end"], unit="us")})

    def close(self) -> None:
        pass


def stuck_jobs(events: DataFrame, idle: str = "1 hour", delay: str = "10 minutes", buckets: int = JOB_BUCKETS) -> DataFrame:
    """T08 with timers: a job without events for ``idle`` of event time that
    has not finished is reported once, with the status it reached since it
    last was idle, and its state is dropped.  Jobs are dealt to ``buckets``
    keyed states by a hash, since a call per job costs more than its work; a
    bucket holds its open spans only.  The number is fixed for a checkpoint.
    Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``)."""
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    bucket = F.pmod(F.xxhash64("client_id", "ingest_id"), F.lit(buckets)).cast("int")
    jobs = ranked(events).withColumn("bucket", bucket).withWatermark("timestamp", delay).groupBy("bucket")
    return jobs.transformWithStateInPandas(JobWatch(idle_ms), STUCK_SCHEMA, "append", "EventTime")


def stuck_jobs_batch(events: DataFrame, idle: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """T08 batch twin: sessions with an ``idle`` gap that end unfinished at
    least ``idle`` before the last watermark (latest event less ``delay``)."""
    idle_ms, delay_ms = (int(pd.Timedelta(x).total_seconds() * 1000) for x in (idle, delay))
    spans = ranked(events).groupBy("client_id", "ingest_id", F.session_window("timestamp", f"{idle_ms} milliseconds").alias("w")).agg(
        F.max(F.struct("rank", "timestamp", "status"))["status"].alias("status"), F.max("timestamp").alias("last_event"))
    latest = events.agg((F.unix_millis(F.max("timestamp")) - delay_ms).alias("mark"))
    done = spans.join(F.broadcast(latest)).where(F.unix_millis("last_event") + idle_ms <= F.col("mark"))
    return done.where(F.col("status").isNull() | ~F.col("status").isin(*TERMINAL)).select("client_id", "ingest_id", "status", "last_event")


# --------------------------------------------------------------------------
# The keyed sink.
# --------------------------------------------------------------------------
def keyed(events: DataFrame) -> DataFrame:
    """(key, value, headers) records as a broker sink takes them; the key
    is client:ingest, the value the envelope as JSON."""
    header = lambda c: F.struct(F.lit(c).alias("key"), F.col(c).alias("value"))
    fields = [c for c in ENVELOPE_COLUMNS if c in events.columns]
    return events.select(F.concat_ws(":", "client_id", "ingest_id").alias("key"),
                         F.to_json(F.struct(*fields), {"timestampFormat": TS_FORMAT}).alias("value"),
                         F.array(*[header(c) for c in ("event_type", "client_id", "trace_id")]).alias("headers"), "timestamp", "event_id")


def keyed_sink(path: str, partitions: int = 8):
    """A ``foreachBatch`` writer that keeps each key's records in order:
    read by (batch_id, offset), a key's records come in the order of time.
    Records are dealt by ranges of (key, time), so a key with a third of all
    records is written by several tasks, one after the other in offsets.  A
    replayed batch replaces its folder."""
    def write(df: DataFrame, batch_id: int):
        order = ["key", "timestamp", "event_id"]
        dealt = keyed(df).repartitionByRange(partitions, *order).sortWithinPartitions(*order)
        (dealt.withColumn("offset", F.monotonically_increasing_id()).drop("timestamp", "event_id")
         .write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}"))
    return write


# --------------------------------------------------------------------------
# Retries and dead letters.
# --------------------------------------------------------------------------
def read_attempts(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Envelopes with their number of earlier attempts (none: 0) and the raw
    line of those that do not parse."""
    r = (spark.readStream.schema(ENVELOPE_DDL + ", attempts int, _corrupt string").option("mode", "PERMISSIVE")
         .option("columnNameOfCorruptRecord", "_corrupt").option("timestampFormat", TS_FORMAT))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.json(path).withColumn("attempts", F.coalesce("attempts", F.lit(0)))


def retrying(handler, done: str, retry: str, dead: str, max_retries: int = 3):
    """A ``foreachBatch`` writer around ``handler``, which takes a frame
    of envelopes and returns it with an ``error`` column (null: handled).

    Handled events go to ``done``; failed ones go back to ``retry`` with one
    attempt more, as events the stream reads again, until ``max_retries`` are
    used up.  Those, lines that do not parse and envelopes without their keys
    go to ``dead``: event_type dlq.<type>, original_event_type, error,
    attempts and the original.  The batch is written once before it is split,
    so the handler runs once; every sink overwrites the batch's own folder,
    so a replayed batch replaces what it wrote."""
    def write(df: DataFrame, batch_id: int):
        spark = df.sparkSession
        missing = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in ("event_type", "client_id", "ingest_id")])
        bad = (F.when(F.col("_corrupt").isNotNull(), F.lit("malformed event"))
                .when(missing != "", F.concat(F.lit("missing envelope field: "), missing)))
        split = df.withColumn("broken", bad)
        ran = handler(split.where("broken is null").drop("_corrupt", "broken"))
        whole = ran.unionByName(split.where("broken is not null").withColumnRenamed("broken", "error"), allowMissingColumns=True)
        path = f"{done}-batches/{batch_id}"
        whole.withColumn("attempts", F.col("attempts") + 1).write.mode("overwrite").parquet(path)
        rows = spark.read.parquet(path)
        permanent = F.col("_corrupt").isNotNull() | F.col("client_id").isNull() | F.col("ingest_id").isNull() | F.col("event_type").isNull()
        failed = F.col("error").isNotNull()
        last = failed & (permanent | (F.col("attempts") > max_retries))
        rows.where(~failed).drop("error", "_corrupt").write.mode("overwrite").parquet(f"{done}/batch_id={batch_id}")
        again = rows.where(failed & ~last).select(*ENVELOPE_COLUMNS, "attempts")
        again.write.mode("overwrite").option("timestampFormat", TS_FORMAT).json(f"{retry}/retry-{batch_id}")
        original = F.coalesce("_corrupt", F.to_json(F.struct(*ENVELOPE_COLUMNS), {"timestampFormat": TS_FORMAT}))
        (rows.where(last).select(F.concat(F.lit("dlq."), F.coalesce("event_type", F.lit("unknown"))).alias("event_type"), F.col("event_type").alias("original_event_type"),
                                 "event_id", "client_id", "ingest_id", "error", "attempts", original.alias("original"))
         .write.mode("overwrite").parquet(f"{dead}/batch_id={batch_id}"))
    return write


def milestones(events: DataFrame) -> DataFrame:
    """Lineage-updated events for significant milestones."""
    return events.filter(F.col("event_type").isin(*MILESTONES)).select(
        F.concat_ws("-", F.lit("lineage"), "ingest_id", "event_type").alias("event_id"),
        F.lit("lineage.updated").alias("event_type"), "client_id", "ingest_id",
        F.col("event_type").alias("milestone"),
        F.concat_ws("-", F.lit("lineage"), "client_id", "ingest_id", "event_type").alias("idempotency_key"),
        "timestamp")


def stage_latency(events: DataFrame) -> DataFrame:
    """T10 batch: first time each stage was reached per job, and the
    seconds between consecutive stages (pivot on explicit stage names)."""
    p = (events.filter(F.col("event_type").isin(*STAGE_ORDER))
         .groupBy("client_id", "ingest_id").pivot("event_type", STAGE_ORDER).agg(F.min("timestamp")))
    cols = []
    for a, b in zip(STAGE_ORDER, STAGE_ORDER[1:]):
        cols.append((F.unix_timestamp(F.col(f"`{b}`")) - F.unix_timestamp(F.col(f"`{a}`")))
                    .alias(f"s_{a.split('.')[0]}_to_{b.split('.')[0]}"))
    return p.select("client_id", "ingest_id", *cols)


def throughput_stream(events: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """T10 streaming: events per stage per event-time window."""
    return (events.withWatermark("timestamp", delay)
            .groupBy(F.window("timestamp", window).alias("w"), "event_type")
            .agg(F.count("*").alias("n_events")))


def apply_retention(events: DataFrame, as_of) -> DataFrame:
    """Keep events younger than their topic's retention."""
    days = F.create_map(*[F.lit(x) for kv in TOPIC_RETENTION_DAYS.items() for x in kv])
    keep = F.coalesce(F.element_at(days, F.col("event_type")), F.lit(7))
    return events.filter(F.col("timestamp") >= F.lit(as_of).cast("timestamp") - F.make_interval(days=keep))


def latest_nodes_stream(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Per (client, ingest, node type) the latest event's metadata --
    the keyed state the lineage tracker keeps in memory, here in the state
    store, one day window per ingest so the watermark evicts it; the sink
    folds the windows with ``fold_latest_nodes``."""
    m = F.create_map(*[F.lit(x) for kv in NODE_TYPES.items() for x in kv])
    e = events.withColumn("node_type", F.coalesce(F.element_at(m, F.col("event_type")), F.lit("unknown")))
    return (e.withWatermark("timestamp", delay)
            .groupBy("client_id", "ingest_id", "node_type", F.window("timestamp", "1 day").alias("w"))
            .agg(F.max_by(F.struct("timestamp", "event_id", "payload"), F.struct("timestamp", "event_id"))
                 .alias("l"), F.min("timestamp").alias("created_at")))


def fold_latest_nodes(emitted: DataFrame) -> DataFrame:
    """One row per node from all rows a node stream emitted: the latest
    event's metadata and the earliest creation over all windows."""
    return emitted.groupBy("client_id", "ingest_id", "node_type").agg(
        F.max(F.struct("l.timestamp", "l.event_id", "l.payload")).alias("l"), F.min("created_at").alias("created_at"))
