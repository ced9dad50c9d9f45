"""The driver's contract, with and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def names(root):
    code = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout
    return [set(x.split()) for x in out.splitlines()[-2:]]


def test_core_works_alone(tmp_path):
    shutil.copytree(REPO / "layerwise", tmp_path / "layerwise", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    queries, sql = names(tmp_path)
    assert "exclusion_rules" in queries and sql == queries and not any(q.startswith("op") for q in queries)


def test_nothing_imports_the_corpus_operators():
    for f in (REPO / "layerwise").rglob("*.py"):
        if "llm" not in f.relative_to(REPO).parts:
            assert "llm" not in f.read_text()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
