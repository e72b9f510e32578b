"""Every registered query against its SQL, on the smallest test set."""

import os

import pytest
from checking import compare, duck

from seepage.plans import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, con, name):
    assert name in ORACLES
    assert compare(spark, con, SF, QUERIES[name], ORACLES[name]) is None


def test_entry_points():
    import __spark_entry__ as entry

    assert entry.queries().keys() >= QUERIES.keys()
    assert set(entry.oracle_sql()) <= set(entry.queries())
