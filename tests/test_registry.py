"""The registry with and without the optional parts of the repository."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; print(len(e.queries()), sum(n.startswith('op') or n == 'pipeline' for n in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"


def _registered(root):
    out = subprocess.run([sys.executable, "-c", LIST], cwd=root, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": ""})
    assert out.returncode == 0, out.stderr
    total, corpus, sql = out.stdout.split()
    assert sql == "True"
    return int(total) - int(corpus), int(corpus)


def _copy(to, *left_out):
    shutil.copytree(os.path.join(ROOT, "hybridrank"), to / "hybridrank", ignore=lambda d, names: [n for n in names if n in (*left_out, "__pycache__")])
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), to)
    return to


def test_registry_without_the_corpus_operators(tmp_path):
    whole, _ = _registered(ROOT)
    assert _registered(_copy(tmp_path, "llm")) == (whole, 0)


def test_registry_when_the_pipeline_outlives_its_operators(tmp_path):
    whole, _ = _registered(ROOT)
    (_copy(tmp_path, "llm") / "corpus_pipeline.py").write_text("from hybridrank.llm import mixing\n")
    assert _registered(tmp_path) == (whole, 0)
