"""The entry module without the optional corpus operators."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [("millrace/llm", "tests/llm"), ("millrace/llm", "tests/llm", "corpus_pipeline.py")])
def test_import_without_corpus_operators(tmp_path, gone):
    def left_out(folder: str, names: list[str]) -> list[str]:
        inside = os.path.relpath(folder, ROOT)
        return [n for n in names if n in (".git", "__pycache__") or os.path.normpath(os.path.join(inside, n)) in gone]

    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=left_out)
    code = "import __spark_entry__ as e; print(sorted(n for n in e.queries() if n.startswith('op') or n == 'pipeline'), len(e.queries()) > 100)"
    found = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert found.returncode == 0, found.stderr
    assert found.stdout.split("] ")[1].strip() == "True" and "op1_" not in found.stdout and "pipeline" not in found.stdout
