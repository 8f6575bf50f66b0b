import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
LEFT_OUT = {"subpackage": ["cinequarry/llm", "tests/llm"], "subpackage and pipeline": ["cinequarry/llm", "tests/llm", "corpus_pipeline.py"]}


@pytest.mark.parametrize("gone", LEFT_OUT.values(), ids=LEFT_OUT)
def test_entry_without_the_subpackage(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", *[Path(x).name for x in gone]))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 76 and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)
