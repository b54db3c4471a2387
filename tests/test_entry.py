"""The driver's contract, with and without the optional subpackage."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 50
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_optional_part(tmp_path):
    for p in ["__spark_entry__.py", *(str(p.relative_to(ROOT)) for p in (ROOT / "tidelog").rglob("*.py") if "llm" not in p.parts)]:
        to = tmp_path / p
        to.parent.mkdir(parents=True, exist_ok=True)
        to.write_text((ROOT / p).read_text())
    code = "import __spark_entry__ as e; assert len(e.queries()) > 80 and not [n for n in e.queries() if n.startswith('op')]; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})


def test_nothing_else_imports_the_optional_part():
    for p in (ROOT / "tidelog").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "llm" not in p.read_text().replace("_llm", ""), p
