"""The driver contract."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__spark_entry__.__file__).parent


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_imports_need_no_session():
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) > 80"], cwd=ROOT, check=True, timeout=120)


def test_graph_modules_do_not_import_the_corpus_operators():
    for path in (ROOT / "veingraph").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "veingraph.llm" not in path.read_text(), path
