"""Executors need not have the package: worker functions travel whole."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]

SCRIPT = """
import os, sys
sys.path.insert(0, {repo!r})  # this process only; workers start without it
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", {shared!r}).getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
from tissuegrid.llm.queries import QUERIES
def lacks(_):
    try:
        import tissuegrid
    except ImportError:
        return [True]
    return [False]
assert spark.sparkContext.parallelize([0], 1).mapPartitions(lacks).collect() == [True]
for name in {names!r}:
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("all done")
"""


def test_every_operator_runs_where_the_package_is_missing(spark, tmp_path):
    from tissuegrid.llm.queries import QUERIES

    script = SCRIPT.format(repo=str(REPO), shared=str(tmp_path / "shared"), names=sorted(QUERIES))
    (tmp_path / "run.py").write_text(script)
    done = subprocess.run([sys.executable, str(tmp_path / "run.py")], cwd=tmp_path, capture_output=True, text=True, timeout=900)
    assert "all done" in done.stdout, done.stderr[-3000:]
