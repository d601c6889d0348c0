"""The entry module imports, and the ledger queries are all there, in a copy without the corpus folders."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = "import __spark_entry__ as e; print(' '.join(sorted(e.queries())))"


@pytest.mark.parametrize("keep_pipeline", [False, True])
def test_entry_without_corpus_folders(tmp_path, keep_pipeline):
    from alertledger.plans.registry import QUERIES

    copy = tmp_path / "copy"
    shutil.copytree(os.path.join(ROOT, "alertledger"), copy / "alertledger", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), copy)
    if keep_pipeline:
        shutil.copy(os.path.join(ROOT, "corpus_pipeline.py"), copy)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", PROBE], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == sorted(QUERIES)
