"""The driver imports __spark_entry__ from elsewhere: Python-backed queries
must still find the package in their workers (it ships itself)."""

import os
import subprocess
import sys
import tempfile

from conftest import ROOT, SF_SMALL

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as E
print("ENTRY", E.entry(spark).count())
print("NODES", E.queries()["page_nodes"](spark, {SF_SMALL!r}).count())
spark.stop()
"""


def test_queries_run_from_another_directory():
    cwd = tempfile.mkdtemp(prefix="newsflux-cwd-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True, text=True,
                         timeout=600)
    assert "ENTRY 10" in out.stdout, out.stderr[-2000:]
    assert "NODES" in out.stdout, out.stderr[-2000:]
