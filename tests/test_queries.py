"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as driver
from tests.oracle import check, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query_equals_sql(spark, con, name):
    found = check(spark, con, name, FOLDER)
    assert found in (None, "the SQL gives no rows"), found


def test_entry_has_rows(spark):
    assert driver.entry(spark).limit(1).count() == 1
