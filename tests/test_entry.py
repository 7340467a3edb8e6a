import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    if os.path.isdir(entry.SMOKE_DIR):
        assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("pipeline_left", [False, True])
def test_without_the_text_operators(tmp_path, pipeline_left):
    shutil.copytree(ROOT / "flockline", tmp_path / "flockline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if pipeline_left and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert n and not any(k.startswith('op') or k == 'pipeline' for k in n); assert set(e.oracle_sql()) <= set(n)"
    env = {**os.environ, "PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)


def test_nothing_else_imports_the_text_operators():
    for f in (ROOT / "flockline").rglob("*.py"):
        if "llm" not in f.parts:
            assert ".llm" not in f.read_text(), f
