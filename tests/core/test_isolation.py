"""The library without its optional operators: the entry imports and its queries run."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
CODE = """
import __spark_entry__ as entry
names = set(entry.queries())
assert names and not [n for n in names if n.startswith("op") and n[2].isdigit()], names
assert ("pipeline" in names) == {pipeline}
assert set(entry.oracle_sql()) <= names
"""


def _copy(tmp_path, *left_out):
    skipped = shutil.ignore_patterns(".git", "__pycache__", "llm", *left_out)
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skipped)
    return tmp_path / "repo"


def _run(folder):
    code = CODE.format(pipeline=False)
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(folder)})


def test_entry_without_the_optional_folders(tmp_path):
    run = _run(_copy(tmp_path))
    assert run.returncode == 0, run.stderr


def test_entry_without_the_folders_and_the_pipeline(tmp_path):
    run = _run(_copy(tmp_path, "corpus_pipeline.py"))
    assert run.returncode == 0, run.stderr


def test_nothing_else_imports_the_optional_folder():
    allowed = {ROOT / "__spark_entry__.py", ROOT / "corpus_pipeline.py"}
    for path in ROOT.rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts and path not in allowed and "tests" not in path.relative_to(ROOT).parts:
            assert "factloom.llm" not in path.read_text() and "from .llm" not in path.read_text(), path
