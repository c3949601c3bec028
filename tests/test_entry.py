"""The driver's entry points, with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_and_oracles():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_training_data_operators(tmp_path):
    here = tmp_path / "repo"
    shutil.copytree(ROOT, here, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    shutil.rmtree(here / "lodestone" / "llm", ignore_errors=True)
    shutil.rmtree(here / "tests" / "llm", ignore_errors=True)
    says = "import __spark_entry__ as e; q = e.queries(); print(len(q), set(e.oracle_sql()) <= set(q), 'pipeline' in q)"
    for _ in range(2):  # with corpus_pipeline.py, then without
        out = subprocess.run([sys.executable, "-c", says], cwd=here, env={**os.environ, "PYTHONPATH": str(here)}, capture_output=True, text=True, timeout=120)
        assert out.returncode == 0, out.stderr
        n, subset, pipeline = out.stdout.split()
        assert int(n) > 90 and subset == "True" and pipeline == "False"
        (here / "corpus_pipeline.py").unlink(missing_ok=True)
