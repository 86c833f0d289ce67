"""The driver's contract, also without the training-data subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
HAVE_DATA = os.path.isdir("/root/testdata/sf0.001")


def test_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"clone_groups", "clone_groups_ranked"} <= set(entry.queries())


@pytest.mark.skipif(not HAVE_DATA, reason="no test tables here")
def test_flagship(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert sorted(r.clone_no for r in rows) == list(range(1, len(rows) + 1)) and rows


def test_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "twinleaf", tmp_path / "twinleaf", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'clone_groups' in q and not [k for k in q if k.startswith('op') or k == 'pipeline']; e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
