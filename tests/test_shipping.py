"""The package reaches Python workers that do not start in its folder."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
JOB = """
import sys
from pyspark.sql import SparkSession, functions as F

spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.addPyFile(sys.argv[1])
from basketrank.functions.vectors import top_k_by_dot

rows = spark.range(6).select(
    F.col("id").alias("customer_id"), F.col("id").cast("string").alias("item_id"),
    F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vec"),
)
found = top_k_by_dot(rows.drop("item_id"), rows.drop("customer_id"), 2, dims=2)
print("found", sorted((r.customer_id, r.pos, r.item_id) for r in found.collect())[:2])
"""


def test_a_zipped_package_runs_from_another_folder(tmp_path):
    (tmp_path / "stage").mkdir()
    shutil.copytree(ROOT / "basketrank", tmp_path / "stage" / "basketrank", ignore=shutil.ignore_patterns("__pycache__"))
    archive = shutil.make_archive(str(tmp_path / "basketrank"), "zip", tmp_path / "stage")
    (tmp_path / "job.py").write_text(JOB)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run(
        [sys.executable, "job.py", archive], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert "found [(0, 1, '0'), (0, 2, '1')]" in run.stdout, run.stderr[-2000:]
