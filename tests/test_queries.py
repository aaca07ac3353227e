"""Every named query against its SQL at the smallest scale."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, duck

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    result = compare(spark, con, SF_DIR, name)
    assert result.startswith("ok" if name in oracle_sql() else "ROWS"), result


def test_entry(spark):
    assert entry(spark).count() > 0
