"""Run every registered query against its DuckDB oracle.

usage: python tools/check_oracles.py [sf_dir] [name ...]
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vetrina.plans import ORACLES, QUERIES  # noqa: E402
from vetrina.plans.compare import compare, duckdb_conn  # noqa: E402
from vetrina.session import build_session  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duckdb_conn(sf_dir)
    bad = 0
    for n in names:
        t = time.time()
        try:
            r = compare(spark, con, n, sf_dir, QUERIES, ORACLES)
        except Exception as e:  # report and go on
            r = {"name": n, "status": "ERROR", "error": str(e)[:800]}
        r["sec"] = round(time.time() - t, 2)
        bad += r["status"] not in ("match", "rows-only")
        print(json.dumps(r, default=str), flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    spark.stop()


if __name__ == "__main__":
    main()
