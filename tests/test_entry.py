"""The library stands without the training-data operators and their pipeline."""

import os
import shutil
import subprocess
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(n.startswith('op1_') for n in q))"


@pytest.mark.parametrize("gone", [["corpus_pipeline.py", "slotwise/llm"], ["slotwise/llm"], ["corpus_pipeline.py"]])
def test_import_without_parts(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(HERE, copy, ignore=lambda d, names: [
        n for n in names if n in (".git", "__pycache__", "tests") or os.path.relpath(os.path.join(d, n), HERE) in gone
    ])
    if "slotwise/llm" in gone:  # what a deletion of sources may leave behind
        (copy / "slotwise" / "llm" / "__pycache__").mkdir(parents=True)
    done = subprocess.run([sys.executable, "-c", SHOW], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    count, pipeline, first = done.stdout.split()
    assert int(count) > 100 and pipeline == "False" and first == str("slotwise/llm" not in gone and os.path.isdir(f"{HERE}/slotwise/llm"))
