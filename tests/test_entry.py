"""The driver contract where the corpus subpackage and its tests are deleted."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def _names(folder):
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    run = subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    return [set(line.split()) for line in run.stdout.splitlines()[-2:]]


def test_queries_without_the_corpus_folders(tmp_path):
    shutil.copytree(ROOT, tmp_path / "all", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    every, oracles = _names(tmp_path / "all")
    for pipeline in (True, False):
        copy = tmp_path / f"some-{pipeline}"
        shutil.copytree(tmp_path / "all", copy)
        shutil.rmtree(copy / "timelode/llm", ignore_errors=True)
        shutil.rmtree(copy / "tests/llm", ignore_errors=True)
        if not pipeline:
            (copy / "corpus_pipeline.py").unlink(missing_ok=True)
        names, sql = _names(copy)
        corpus = {n for n in every if n == "pipeline" or n.startswith("op") and n[2:3].isdigit()}
        assert names == every - corpus and sql == oracles - corpus
