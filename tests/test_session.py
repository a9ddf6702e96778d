"""Stored tables and their removal, in an application of its own."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pathlib import Path
from pyspark.sql import SparkSession
from tissuegrid import session
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {shared!r}).getOrCreate())
kept = session.cut(spark.range(10))
kept.write.parquet({out!r})
assert list(Path({shared!r}).rglob("*.parquet"))
session.release(spark)
assert not list(Path({shared!r}).rglob("*.parquet"))
session.release(spark)  # nothing left, nothing to do
assert spark.read.parquet({out!r}).count() == 10 and session.cut(spark.range(3)).count() == 3
print("all done")
"""


def test_release_drops_every_stored_table(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(repo=str(REPO), shared=str(tmp_path / "shared"), out=str(tmp_path / "out")))
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "all done" in done.stdout, done.stderr[-2000:]
