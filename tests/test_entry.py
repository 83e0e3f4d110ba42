import os
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as e
from plumbline import shipping

ROOT = Path(__file__).resolve().parents[1]


def test_contract(spark):
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_path_is_checked(monkeypatch, tmp_path):
    monkeypatch.setenv("PYTHONPATH", f"/nowhere:{ROOT}")
    assert shipping.found()
    monkeypatch.setenv("PYTHONPATH", "/nowhere")
    monkeypatch.chdir(tmp_path)
    assert not shipping.found()


def test_queries_run_from_any_folder(tmp_path, sf):
    """Python workers get the package although neither the folder nor PYTHONPATH leads to it."""
    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("ROWS", e.queries()["dtw_assign"](s, {sf!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "ROWS 15" in out.stdout, out.stderr[-2000:]


def test_rest_works_without_the_subpackage(tmp_path):
    """With the subpackage and its tests gone, and with the pipeline gone or not, the entry imports and has the other queries."""
    import shutil

    for k, also in enumerate(((), ("corpus_pipeline.py",))):
        root = tmp_path / str(k)
        shutil.copytree(ROOT, root, ignore=shutil.ignore_patterns(".git", "__pycache__", *also))
        shutil.rmtree(root / "plumbline/llm", ignore_errors=True)
        shutil.rmtree(root / "tests/llm", ignore_errors=True)
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and Path(p).resolve() != ROOT)}
        out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') or k == 'pipeline' for k in e.queries()))"], cwd=root, env=env, capture_output=True, text=True, timeout=100)
        assert out.stdout.split()[1:] == ["False"] and int(out.stdout.split()[0]) >= 30, out.stderr[-2000:]
