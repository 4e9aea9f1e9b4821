"""Queries where the package is on the driver's path alone, as on a cluster whose executors lack it."""

import subprocess
import sys
import tempfile
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
s = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
     .config("spark.checkpoint.dir", "file://{shared}").config("spark.sql.session.timeZone", "UTC").getOrCreate())
import __spark_entry__
for name, query in __spark_entry__.queries().items():
    if name == "pipeline" or name.startswith("op"):
        query(s, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
        print("ran", name)
"""


def test_queries_run_where_workers_lack_the_package(tmp_path):
    code = SCRIPT.format(repo=str(REPO), shared=tempfile.mkdtemp(prefix="spark-"))
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=900, env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})
    assert done.stdout.count("ran ") == 14, done.stderr[-3000:]
