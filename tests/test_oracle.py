"""Every registered query with check SQL, compared with DuckDB on whole tables."""

import os

import pytest
from oracle import compare, connect

import __spark_entry__ as entry_module

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = entry_module.oracle_sql()
QUERIES = entry_module.queries()
# Fit 27 models; their parts are tested in test_models and test_linear.
SLOW = {"run_ablation", "ablation_to_significance"}
CHECKED = sorted(set(SQL) - SLOW)
# Tested against plain versions in their own folder.
SLOW |= {name for name in QUERIES if name.startswith("op") or name == "pipeline"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    assert compare(got, duck.sql(SQL[name]).df()) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_runs(spark, name):
    assert len(QUERIES[name](spark, SF_DIR).toPandas()) > 0


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert {r["label"] for r in rows} == {0, 1}
