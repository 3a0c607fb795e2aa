"""The registry: every query has a name and SQL or a reason, and the subpackage may be absent."""

import os
import shutil
import subprocess
import sys

import __spark_entry__
from tessera.plans import suite

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_own_query_has_sql():
    assert set(suite.QUERIES) == set(suite.SQL) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def run(folder, code):
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(folder)})


def test_without_the_subpackage(tmp_path):
    shutil.copytree(f"{ROOT}/tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    got = run(tmp_path, "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op1') for n in e.queries()))")
    assert got.stdout.split() == [str(len(suite.QUERIES)), "False"], got.stderr


def test_a_missing_package_is_not_hidden(tmp_path):
    shutil.copytree(f"{ROOT}/tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "tessera/llm").mkdir()
    (tmp_path / "tessera/llm/__init__.py").write_text("")
    (tmp_path / "tessera/llm/registry.py").write_text("import no_such_package\n")
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    assert "no_such_package" in run(tmp_path, "import __spark_entry__").stderr
