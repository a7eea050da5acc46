"""The package reaches Python workers that do not have it on their path."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from __spark_entry__ import queries
print("ROWS", queries()["topk_vectors"](spark, "/root/testdata/sf0.001").count())
"""


def test_query_with_workers_from_another_folder():
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd="/", env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 45000" in out.stdout, out.stderr[-2000:]
