"""The entry works without the operators for training data, or without what they need."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("missing", ["schemalign.llm", "public_tokenizers", "xxhash", "corpus_pipeline"])
def test_queries_without(missing):
    code = f"""
import sys, warnings
warnings.simplefilter("ignore")
sys.modules[{missing!r}] = None
import __spark_entry__ as entry
names = entry.queries()
assert "field_match_top3" in names and not any(n.startswith("op1") or n == "pipeline" for n in names)
assert set(entry.oracle_sql()) <= set(names)
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
