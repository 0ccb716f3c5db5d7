"""Every registered query has SQL; a sample agrees on the smallest data."""

from __future__ import annotations

import pathlib
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as registry
from barloom.plans import registry as core

DATA = pathlib.Path("/root/testdata/sf0.001")


def test_every_query_has_sql():
    """Queries of the optional training-data package may have none; their own tests judge those."""
    assert set(core.QUERIES) == set(core.ORACLES)
    assert set(core.QUERIES) <= set(registry.queries())
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_sample_of_queries_agrees_with_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{DATA}/lineitem.parquet'")
    for name in ("bars_daily", "donchian_channels", "weekly_bars", "dq_session", "cross_source_report"):
        df = registry.queries()[name](spark, str(DATA))
        cursor = db.execute(registry.oracle_sql()[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        theirs = sorted((tuple(r) for r in cursor.fetchall()), key=repr)
        mine = sorted((tuple(r) for r in df.select(columns).collect()), key=repr)
        assert mine == theirs and mine, name


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_entry_runs(spark):
    rows = registry.entry(spark).collect()
    assert {r.metric for r in rows} == {"total_return", "cagr", "volatility", "sharpe", "max_drawdown"}


def test_core_queries_remain_without_the_optional_parts(tmp_path):
    root = pathlib.Path(__file__).resolve().parents[1]
    shutil.copytree(root / "barloom", tmp_path / "barloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert run.stdout.split() == [str(len(core.QUERIES)), "False"]
