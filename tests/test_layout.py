"""The library stands without its optional subpackage."""

import pathlib
import re
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_optional_subpackage():
    for path in (ROOT / "lanternfish").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "lanternfish").parts:
            assert not re.search(r"lanternfish\.llm|from lanternfish import llm", path.read_text()), path


def test_no_local_checkpoints():
    for path in (ROOT / "lanternfish").rglob("*.py"):
        assert "localCheckpoint" not in path.read_text(), path


def test_the_rest_stands_alone(tmp_path):
    """With the optional folders taken away, with and without the pipeline's file, the entry has the library's queries only."""
    for pipeline in (True, False):
        copy = tmp_path / str(pipeline)
        shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *(() if pipeline else ("corpus_pipeline.py",))))
        assert not (copy / "lanternfish/llm").exists() and (copy / "corpus_pipeline.py").exists() == pipeline
        code = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q), set(e.oracle_sql()) <= set(q))"
        said = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
        assert said.returncode == 0, said.stderr
        n, optional, known = said.stdout.split()
        assert int(n) > 100 and optional == "0" and known == "True"
