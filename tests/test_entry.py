"""The entry imports on a copy of the repository without the subpackage ``llm``, with and without the pipeline beside it."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_without_llm(tmp_path, with_pipeline):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "*.json", "*.md", *([] if with_pipeline else ["corpus_pipeline.py"])))
    code = "import sys, __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') or n == 'pipeline' for n in set(e.queries()) - set(e._core.QUERIES)), any(m.startswith('playlake.llm') for m in sys.modules))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)})
    assert out.returncode == 0, out.stderr
    from playlake import queries

    assert out.stdout.split()[-4:] == [str(len(queries.QUERIES)), str(len(queries.ORACLE_SQL)), "False", "False"]
