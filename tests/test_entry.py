"""The entry in a copy of the repository without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert set(s) <= set(q); print(len(q), 'pipeline' in q, any(n.startswith('op') for n in q))"


@pytest.mark.parametrize("gone", [["corpusloom/llm", "tests/llm"], ["corpusloom/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_without_the_subpackage(tmp_path, gone):
    to = tmp_path / "copy"
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        at = to / name
        shutil.rmtree(at, ignore_errors=True) if at.is_dir() or not at.suffix else at.unlink(missing_ok=True)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SAYS], cwd=to, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, pipeline, op = out.stdout.split()
    assert int(n) > 200 and pipeline == op == "False"
