"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs to completion through the ``noop`` sink (full execution,
nothing collected).  Before timing, every headline query runs once,
untimed, on the smallest data set ($BENCH_WARMUP_DIR, sf0.001), so the
timed runs measure steady state: JVM JIT and Spark's compiled-code cache
are warm, as they are for a long-running job; set BENCH_WARMUP=0 to time
cold runs.  Prints one JSON line: total seconds, per-query seconds, and
row throughput of the flagship next to the reference's published figure
(about 278 rows/s per agent).
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "a11_gate", "v09_issues", "p04_p09_transforms", "f10_normalize_products", "f11_normalize_features",
    "a01_profile_lineitem", "a03_a05_column_stats", "a12_quality_dimensions", "e02_gtin_resolution",
    "e02_cross_supplier_merge", "r02_features_wide", "g01_ancestors", "p11_template_assembly",
    "t08_job_status", "s04_delimiter", "f14_duplicate_rows",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    from vetrina.plans import QUERIES
    from vetrina.session import build_session
    spark = build_session(f"local[{cpus}]", app="vetrina-bench", shuffle_partitions=int(cpus) * 2)
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in QUERIES]
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    warm = os.environ.get("BENCH_WARMUP", "1") != "0" and os.path.isdir(warm_dir)
    for n in (names if warm else ["f05_normalize_gtin"]):
        QUERIES[n](spark, warm_dir if warm else sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t = time.perf_counter()
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t, 3)
        print(f"{n}: {times[n]}s", file=sys.stderr, flush=True)
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").count()
    total = round(sum(times.values()), 3)
    gate = times.get("a11_gate")
    out = {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times,
           "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus),
           "warmup": f"each query once on {os.path.basename(warm_dir)}" if warm else "none",
           "flagship_rows": rows,
           "flagship_rows_per_sec": round(rows / gate, 1) if gate else None,
           "reference_rows_per_sec_claim": 278}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
