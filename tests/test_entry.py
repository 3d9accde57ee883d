"""The entry point stands without the corpus subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), any(n.startswith('op1_') or n == 'pipeline' for n in q))"


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_queries_without_the_corpus_folders(tmp_path, gone):
    from huntframe import catalog

    copy = str(tmp_path / "copy")
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
    assert not os.path.exists(f"{copy}/huntframe/llm")
    said = subprocess.run([sys.executable, "-c", SAYS], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": copy})
    assert said.stdout.split() == [str(len(catalog.queries())), "False"], said.stderr
