"""What the entry module registers, with this folder's package and without it."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]


def names(root):
    code = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=root, capture_output=True, text=True, check=True)
    return [line.split() for line in done.stdout.strip().split("\n")]


def test_one_query_per_operator_and_the_pipeline():
    queries, twins = names(ROOT)
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in queries) == 1
    assert "pipeline" in queries
    assert {q for q in twins if q.startswith("op")} == {"op6_license_scans", "op8_warc", "op10_quality_rules", "op12_hard_negatives"}


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "shortlist", tmp_path / "shortlist", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    queries, _ = names(tmp_path)
    assert queries and not any(q.startswith("op") and q[2].isdigit() for q in queries) and "pipeline" not in queries
    (tmp_path / "shortlist/llm/__pycache__").mkdir(parents=True)  # a folder left empty is no package either
    assert names(tmp_path)[0] == queries
