"""The driver imports __spark_entry__ from elsewhere: Python workers must
still find the package (pandas UDF / mapInPandas stages)."""
import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "Asia/Tokyo").getOrCreate())
import __spark_entry__ as e
q = e.queries()
print("counts", q["text_normalize"](spark, "/root/testdata/sf0.001").count(),
      q["extract_tables"](spark, "/root/testdata/sf0.001").count(),
      q["score_distinct_cells"](spark, "/root/testdata/sf0.001").count())
spark.stop()
"""


def test_queries_run_from_another_directory():
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tempfile.mkdtemp(prefix="gridwork-cwd-"),
                         env=env, capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-3000:]
    line = [x for x in out.stdout.splitlines() if x.startswith("counts")][0]
    n_probe, n_extract, n_scored = map(int, line.split()[1:])
    assert n_probe > 0 and n_extract > 0 and n_scored > 0
