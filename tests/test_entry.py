"""The driver contract without the optional text subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
PROBE = "import __spark_entry__ as e; q = e.queries(); print(len(q), sorted(n for n in q if n.startswith('op') or n == 'pipeline'), set(e.oracle_sql()) <= set(q))"


def copied(tmp_path, left_out):
    skip = shutil.ignore_patterns(".git", "__pycache__", "tests")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=lambda folder, names: skip(folder, names) | {n for n in names if n in left_out})
    return tmp_path / "copy"


@pytest.mark.parametrize("left_out, leftovers", [({"llm"}, False), ({"llm"}, True), ({"llm", "corpus_pipeline.py"}, False)])
def test_import_without_the_text_operators(tmp_path, left_out, leftovers):
    copy = copied(tmp_path, left_out)
    if leftovers:
        (copy / "surveyloom" / "llm" / "__pycache__").mkdir(parents=True)
    done = subprocess.run([sys.executable, "-c", PROBE], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    n, rest = done.stdout.split(" ", 1)
    assert int(n) > 50 and rest.strip() == "[] True"
