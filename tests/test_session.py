"""The library must run on a session whose spark.checkpoint.dir is unset
(it cannot be set at runtime): a subprocess with an empty conf folder."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
sys.path.insert(0, %r)
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").getOrCreate()
assert s.conf.get("spark.checkpoint.dir", None) is None
import __spark_entry__ as E
assert E.entry(s).count() > 0
q = E.queries()
assert q["g01_ancestors"](s, "/root/testdata/sf0.001").count() > 0      # written levels
assert q["e02_gtin_resolution"](s, "/root/testdata/sf0.001").count() > 0 # written cut points
print("OK")
""" % ROOT


def test_runs_without_checkpoint_conf():
    conf = tempfile.mkdtemp(prefix="vt-emptyconf-")
    env = dict(os.environ, SPARK_CONF_DIR=conf)
    out = subprocess.run([sys.executable, "-c", SCRIPT], env=env, capture_output=True, text=True, timeout=600)
    assert "OK" in out.stdout, out.stderr[-2000:]
