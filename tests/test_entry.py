"""The entry point: names, SQL for known names only, and life without the llm folders."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(root):
    code = "import __spark_entry__ as e; print('NAMES', *e.queries()); print('SQL', *e.oracle_sql())"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=root, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True).stdout
    return ({*line.split()[1:]} for line in out.splitlines() if line.startswith(("NAMES", "SQL")))


def test_every_sql_has_its_query():
    queries, sql = names(ROOT)
    assert sql <= queries and len(queries) > 90


@pytest.mark.parametrize("gone", [("llm", "corpus_pipeline.py"), ("llm",), ("corpus_pipeline.py",)])
def test_without_llm_folders(tmp_path, gone):
    root = tmp_path / "repo"
    shutil.copytree(ROOT, root, ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
    queries, sql = names(root)
    assert not [q for q in queries if q.startswith("op") and q[2:3].isdigit()] and "pipeline" not in queries and sql <= queries and len(queries) > 80


def test_nothing_else_imports_llm():
    for folder, _, found in os.walk(os.path.join(ROOT, "tidewell")):
        for name in found:
            if name.endswith(".py") and os.sep + "llm" not in folder:
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    assert "import tidewell.llm" not in (text := f.read()) and "from tidewell.llm" not in text
