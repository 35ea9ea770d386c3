"""The driver's contract holds without the text subpackage and its pipeline."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
PROBE = """
import sys
import __spark_entry__ as e
from pyspark.sql import SparkSession
found, sql = e.queries(), e.oracle_sql()
assert set(sql) <= set(found) and not [x for x in found if x == "pipeline" or x[:2] == "op" and x[2].isdigit()], found
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.local.dir", sys.argv[1]).getOrCreate()
assert e.entry(spark).count() == 1
print(len(found))
"""


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_without_the_subpackage(tmp_path, with_pipeline):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "spark-warehouse", *([] if with_pipeline else ["corpus_pipeline.py"])))
    assert not (copy / "markerlake" / "llm").exists()
    done = subprocess.run([sys.executable, "-c", PROBE, str(tmp_path / "local")], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
