"""Every check query with SQL gives the rows DuckDB gives (smallest tables)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as driver  # noqa: E402
from check_oracle import compare, connect  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_same_rows(spark, con, name):
    assert compare(spark, con, name, SF_DIR).startswith("ok")


def test_entry(spark):
    rows = driver.entry(spark).collect()
    assert len(rows) == 20 and rows[0]["df"] >= rows[-1]["df"]
