import importlib
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    e = importlib.import_module("__spark_entry__")
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 80


def test_core_stands_without_the_subpackage(tmp_path):
    code = (
        "import sys; sys.modules['revstrand.llm'] = None\n"
        "import __spark_entry__ as e; from revstrand.plans import registry as r\n"
        "assert set(e.queries()) == set(r.queries()), 'core queries only'"
    )
    got = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert got.returncode == 0, got.stderr


def test_core_never_imports_the_subpackage():
    for p in (ROOT / "revstrand").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p


def test_entry(spark):
    e = importlib.import_module("__spark_entry__")
    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["coarse_detect", "refine_hifi", "read_report", "corrected_reads", "truth_match", "dedup_b", "two_iterations", "ir_windows", "support_rank"])
def test_against_sql(spark, name):
    import duckdb

    e = importlib.import_module("__spark_entry__")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    got = e.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({e.oracle_sql()[name]})").fetchall()
    show = lambda rows: sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
    assert show(map(tuple, got.select(*[f"`{c}`" for c in cols]).collect())) == show(want)
