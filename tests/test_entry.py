"""The registry, with and without the llm subpackage."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_registry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_imports_without_llm(tmp_path):
    """A copy without the subpackage and the pipeline imports and has the other queries."""
    import __spark_entry__ as e

    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "*.json", "*.md"))
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env={**os.environ, "PYTHONPATH": ""}, timeout=120, capture_output=True, text=True, check=True)
    assert done.stdout.split() == sorted(k for k in e.queries() if k != "pipeline" and not re.match(r"op\d+_", k))


def test_a_broken_llm_is_no_missing_one(tmp_path):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "*.json", "*.md"))
    (tmp_path / "copy" / "corpus_pipeline.py").write_text("import no_such_module\n", encoding="utf-8")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path / "copy", env={**os.environ, "PYTHONPATH": ""}, timeout=120, capture_output=True, text=True, check=False)
    assert done.returncode and "no_such_module" in done.stderr
