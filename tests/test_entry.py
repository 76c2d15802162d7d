"""The entry module with and without the training-data operators."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

HIDING = """
import sys
from importlib.machinery import PathFinder

class Absent:
    @staticmethod
    def find_spec(name, path=None, target=None):
        return None if name in {names} else PathFinder.find_spec(name, path, target)

sys.meta_path = [Absent if f is PathFinder else f for f in sys.meta_path]
import __spark_entry__ as entry
print(sorted(n for n in entry.queries() if n.startswith("op") or n == "pipeline"))
"""


@pytest.mark.parametrize("names", [("quarryline.llm",), ("quarryline.llm", "corpus_pipeline"), ("corpus_pipeline",)])
def test_entry_without(names):
    code = HIDING.replace("{names}", repr(names))
    out = subprocess.run(
        [sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120, check=False
    )
    assert out.returncode == 0, out.stderr[-2000:]
    if "quarryline.llm" in names:
        assert out.stdout.strip() == "[]"
    else:
        assert "pipeline" not in out.stdout
