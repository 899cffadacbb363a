import os
import shutil
import subprocess
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import TABLES, digest  # noqa: E402
from pizarra.plans.queries import REGISTRY  # noqa: E402

ROWS_ONLY = set()


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert "departamento" in df.columns and "posicion" in df.columns


def test_every_query_has_an_oracle_or_is_rows_only():
    assert set(REGISTRY) <= set(entry.queries())
    assert set(REGISTRY) - set(entry.oracle_sql()) == ROWS_ONLY


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_oracle(spark, con, sf_small, name):
    got = entry.queries()[name](spark, sf_small).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert digest(got)[0] == digest(want)[0]


@pytest.mark.parametrize("name", ["national_indicators", "department_summary", "gap_all", "share_all", "vs_national", "municipality_counts"])
def test_analytics_plans_stay_in_the_jvm(spark, sf_small, name):
    df = entry.queries()[name](spark, sf_small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "ReadSchema: struct<l_orderkey" in plan  # pruned scan, not all lineitem columns
    assert "l_comment" not in plan and "l_extendedprice" not in plan


def test_entry_works_without_the_training_data_operators(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{root}/pizarra", tmp_path / "pizarra", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.stdout.split() == list(REGISTRY), said.stderr
