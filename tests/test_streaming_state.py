"""Stuck jobs by timers, keyed sink, retries and dead letters."""

import datetime
import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vetrina.streaming import events as S

T0 = datetime.datetime(2024, 1, 1)


def event(i, minutes, kind="file.received", client="c", ingest="i", **more):
    at = T0 + datetime.timedelta(minutes=minutes)
    return {"event_id": str(i), "event_type": kind, "timestamp": at.strftime("%Y-%m-%dT%H:%M:%S.%f"), "trace_id": "t", "client_id": client, "ingest_id": ingest,
            "source_agent": "a", "idempotency_key": str(i), "payload": "{}", **more}


def write(folder, name, events):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(e if isinstance(e, str) else json.dumps(e) for e in events) + "\n")


JOBS = [event(0, 0), event(1, 30, "file.profiled"), event(2, 200, "mapping.applied"),  # idle twice: 30 and 200
        event(3, 0, client="d"), event(4, 20, "persistence.upserted", client="d"),  # finished
        event(5, 5, "odd.type", client="e"), event(6, 59, client="f"), event(7, 118, "validation.results", client="f"),
        event(8, 0, "processing.error", client="g"), event(9, 60, "file.received", client="g"),  # failed; an hour is not idle yet
        event(11, 0, "processing.error", client="h"), event(12, 61, "file.received", client="h"),  # failed, then begun anew
        event(10, 500, client="last")]


def test_merge_spans():
    spans = [(0, 5, 1, 0, "a"), (7, 9, 3, 8, "b"), (20, 21, 2, 20, "c")]
    assert S.merge_spans(spans, 2) == [(0, 9, 3, 8, "b"), (20, 21, 2, 20, "c")]
    assert S.merge_spans(spans, 1) == spans
    bridge = [(9, 20, -1, 9, None)]
    assert S.merge_spans(spans[::-1] + bridge, 2) == [(0, 21, 3, 8, "b")]


@pytest.mark.parametrize("files", [1, 3, 11])
def test_stuck_jobs_do_not_depend_on_batches(spark, tmp_path, files):
    order = list(JOBS)
    random.Random(files).shuffle(order)
    for k in range(files):
        write(tmp_path / "in", f"{k}.json", order[k::files])
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.ROCKSDB)
    try:
        good, _ = S.quarantine_split(S.read_events(spark, str(tmp_path / "in"), 1))
        delay = "10 hours" if files > 1 else "10 minutes"  # files come in any order
        S.run_available(S.stuck_jobs(good, delay=delay), S.idempotent_sink(str(tmp_path / "out")), str(tmp_path / "ckpt"))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted(tuple(r) for r in spark.read.schema(S.STUCK_SCHEMA).parquet(str(tmp_path / "out") + "/*").select("client_id", "status", "last_event").fillna("").collect())
    static = spark.read.schema(S.ENVELOPE_DDL).option("timestampFormat", S.TS_FORMAT).json(str(tmp_path / "in"))
    twin = sorted(tuple(r) for r in S.stuck_jobs_batch(static, delay=delay).select("client_id", "status", "last_event").fillna("").collect())
    at = lambda m: T0 + datetime.timedelta(minutes=m)
    want = [("c", "mapping", at(30)), ("c", "validating", at(200)), ("e", "", at(5)), ("f", "normalizing", at(118)), ("h", "profiling", at(61))]
    assert got == twin == (want if files == 1 else [])


def test_keyed_sink_keeps_order(spark, tmp_path):
    hot = [event(i, i, client="hot") for i in range(300)]
    for k, part in enumerate((hot[:150] + [event(900, 3), event(901, 2, client=None)], hot[150:])):
        write(tmp_path / "in", f"{k}.json", random.Random(k).sample(part, len(part)))
        S.run_available(S.read_events(spark, str(tmp_path / "in")).drop("_corrupt"), S.keyed_sink(str(tmp_path / "out"), 6), str(tmp_path / "ckpt"))
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("batch_id", "offset").collect()
    assert len(rows) == 302 and {r.key for r in rows} == {"hot:i", "c:i", "i"}
    assert [json.loads(r.value)["event_id"] for r in rows if r.key == "hot:i"] == [str(i) for i in range(300)]
    tasks = {r.offset >> 33 for r in rows if r.key == "hot:i"}
    assert len(tasks) > 1  # a hot key is written by several tasks
    assert {h.key: h.value for h in rows[0].headers}.keys() == {"event_type", "client_id", "trace_id"}


def test_retries_and_dead_letters(spark, tmp_path):
    write(tmp_path / "in" / "first", "a.json", [event(1, 0), event(2, 1), event(3, 2), event(4, 3, client=None), '{"event_id": "5", "event_type"', event(6, 4, kind=None, client=None)])
    calls = []

    def handler(df):
        calls.append(1)
        return df.withColumn("error", F.when((F.col("event_id") == "2") & (F.col("attempts") < 2), "busy").when(F.col("event_id") == "3", "always"))

    paths = [str(tmp_path / n) for n in ("done", "dead")]
    for _ in range(5):
        S.run_available(S.read_attempts(spark, str(tmp_path / "in") + "/*"), S.retrying(handler, paths[0], str(tmp_path / "in"), paths[1]), str(tmp_path / "ckpt"))
    done = {r.event_id: r.attempts for r in spark.read.parquet(paths[0]).collect()}
    assert done == {"1": 1, "2": 3}
    dead = {(r.event_type, r.original_event_type, r.error, r.attempts, json.loads(r.original)["event_id"] if r.original.endswith("}") else "broken") for r in spark.read.parquet(paths[1]).collect()}
    assert dead == {("dlq.file.received", "file.received", "always", 4, "3"), ("dlq.file.received", "file.received", "missing envelope field: client_id", 1, "4"),
                    ("dlq.unknown", None, "missing envelope field: event_type, client_id", 1, "6"), ("dlq.unknown", None, "malformed event", 1, "broken")}
    assert 4 <= len(calls) <= 5  # once a batch; the fifth run has at most an empty file to read


def test_spans_of_many_jobs_fold_like_one(spark):
    """A bucket folds its jobs at once, each as ``merge_spans`` does; all jobs
    share a bounded number of states."""
    draw = np.random.default_rng(3)
    jobs = {}
    for _ in range(400):
        start = int(draw.integers(0, 300))
        rank = int(draw.integers(-1, 4))
        span = (start, start + int(draw.integers(0, 9)), rank, start, f"s{rank}" if rank >= 0 else None)
        jobs.setdefault((f"c{draw.integers(0, 5)}", f"i{draw.integers(0, 3)}"), []).append(span)
    rows = pd.DataFrame([(*k, *s) for k, spans in jobs.items() for s in spans], columns=S.JobWatch.COLUMNS)
    got = S.fold_spans(rows.sample(frac=1, random_state=1), 2)
    got["status"] = got["status"].astype(object).where(got["status"].notna(), None)
    want = [(*k, *s) for k, spans in sorted(jobs.items()) for s in S.merge_spans(spans, 2)]
    assert [tuple(r) for r in got.itertuples(index=False)] == want
