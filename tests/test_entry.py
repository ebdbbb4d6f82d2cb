import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def listed(where) -> set[str]:
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print('NAMES', *q)"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=where, env=os.environ | {"PYTHONPATH": str(where)}, capture_output=True, text=True, check=True)
    return set(out.stdout.rpartition("NAMES")[2].split())


@pytest.mark.parametrize("gone", [["quillspan/llm", "tests/llm"], ["quillspan/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_library_stands_alone(tmp_path, gone):
    """In a full copy without the training-data operators the entry module, the other queries and their tests still import."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        if (copy / name).is_dir():
            shutil.rmtree(copy / name)
        else:
            (copy / name).unlink(missing_ok=True)
    names = listed(copy)
    assert "grep_ranges" in names and "pipeline" not in names
    if "quillspan/llm" in gone:
        assert not any(n.startswith("op") and n[2].isdigit() for n in names)
        subprocess.run([sys.executable, "-B", "-m", "pytest", "-q", "--collect-only", "-p", "no:cacheprovider", "tests"], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, check=True)


def test_entry(spark):
    import __spark_entry__

    if os.path.exists(__spark_entry__.SMOKE_DIR):
        assert __spark_entry__.entry(spark).count() > 0
