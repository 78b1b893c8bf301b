"""The entry without the training-data operators, and files that go with their application."""

import os
import shutil
import subprocess
import sys

import pytest
from conftest import ROOT

WITHOUT = {"operators": ("marlstone/llm", "tests/llm"), "operators and pipeline": ("marlstone/llm", "tests/llm", "corpus_pipeline.py")}


@pytest.mark.parametrize("gone", WITHOUT.values(), ids=WITHOUT)
def test_import_without_llm(tmp_path, gone):
    at = shutil.copytree(ROOT, tmp_path / "copy", ignore=lambda d, names: [n for n in names if n in (".git", "__pycache__") or os.path.relpath(os.path.join(d, n), ROOT) in gone])
    code = "import __spark_entry__ as e, marlstone.plans.queries as q; assert set(e.queries()) == set(q.QUERIES) and set(e.oracle_sql()) == set(q.ORACLE_SQL); print(len(e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=at, env=os.environ | {"PYTHONPATH": str(at)}, capture_output=True, text=True)
    assert said.returncode == 0 and int(said.stdout) > 70, said.stderr


def test_files_go_after_stop(tmp_path):
    code = f"""
from pyspark.sql import SparkSession
from marlstone.operators.tables import written
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
assert written(spark.range(5), "five").count() == 5
import os; assert os.listdir("{tmp_path}/shared")
spark.stop()
"""
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": str(ROOT)}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    assert not [x for x in os.listdir(tmp_path / "shared") if x.startswith("five")]
