"""The library without the training-data operators: it imports, and its other queries run."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import __spark_entry__ as e
names = sorted(e.queries())
assert not any(n[:2] == "op" and n[2:3].isdigit() for n in names) and "pipeline" not in names and len(names) > 80, names
assert set(e.oracle_sql()) <= set(names)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert e.entry(spark).count() > 0
assert e.queries()["parse_md"](spark, "/root/testdata/sf0.001").count() > 0
"""


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_without_the_subpackage(tmp_path, with_pipeline):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "*.json", "*.md"))
    if not with_pipeline:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", CODE], cwd=copy, env=env, capture_output=True, text=True, timeout=240)
    assert run.returncode == 0, run.stderr[-3000:]
