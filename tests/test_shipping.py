"""The models run where only the driver's own path has the package."""

from __future__ import annotations

import os
import subprocess
import sys

PROGRAM = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = (
    SparkSession.builder.master("local[1]")
    .config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "2")
    .config("spark.checkpoint.dir", {shared!r})
    .getOrCreate()
)
from hearthtab.plans.queries import QUERIES
print("rows", QUERIES["lpm_base"](spark, {folder!r}).count())
"""


def test_models_run_without_the_package_on_the_workers(small, tmp_path):
    """Python workers know neither the driver's ``sys.path`` nor, here, the folder it names."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run(
        [sys.executable, "-c", PROGRAM.format(repo=repo, folder=small, shared=f"file://{tmp_path}/shared")],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240,
    )
    assert "rows " in run.stdout, run.stderr[-2000:]
    assert int(run.stdout.split("rows ")[1]) > 0
    # What the session put into the shared folder is gone with it.
    left = [p for _, _, files in os.walk(tmp_path / "shared") for p in files]
    assert left == []
