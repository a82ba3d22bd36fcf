"""The entry module, with and without the folders that may be deleted."""

import os
import shutil
import subprocess
import sys

import pytest

TOP = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SHOW = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and callable(e.entry); print(*sorted(q))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_llm(tmp_path, pipeline):
    away = ["llm", ".git", "__pycache__"] + ([] if pipeline else ["corpus_pipeline.py"])
    shutil.copytree(TOP, tmp_path / "copy", ignore=shutil.ignore_patterns(*away))
    names = subprocess.run([sys.executable, "-c", SHOW], cwd=tmp_path / "copy", capture_output=True, text=True, check=True).stdout.split()
    assert "f_imbalance_bar_speed" in names and "pipeline" not in names and not any(n.startswith("op") for n in names)


def test_of_this_tree():
    names = subprocess.run([sys.executable, "-c", SHOW], cwd=TOP, capture_output=True, text=True, check=True).stdout.split()
    parts = [f for f in ("tidemark/llm", "corpus_pipeline.py") if os.path.exists(f"{TOP}/{f}")]
    assert ("pipeline" in names) == (len(parts) == 2)
