"""The driver's contract, and what is left of it without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

CODE = """
import __spark_entry__ as e, bench
q, o = e.queries(), e.oracle_sql()
assert "pipeline" not in q and not any(n.startswith("op") and n[2].isdigit() for n in [*q, *o]) and set(o) <= set(q) and len(q) > 60
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert e.entry(spark).count() > 0
"""


def test_core_works_without_the_llm_folders(tmp_path):
    keep = shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache", "spark-warehouse")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=keep)
    for pipeline in (True, False):  # with corpus_pipeline.py left behind, and without it
        if not pipeline:
            (tmp_path / "repo" / "corpus_pipeline.py").unlink(missing_ok=True)
        done = subprocess.run([sys.executable, "-c", CODE if pipeline else CODE.partition("from pyspark")[0]], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=400)
        assert done.returncode == 0, done.stderr[-2000:]


def test_no_core_module_imports_the_llm_subpackage():
    for path in (ROOT / "closebook").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text().replace("closebook/llm", "")
