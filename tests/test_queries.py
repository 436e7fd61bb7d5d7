"""Every registered query of the domain against its SQL twin."""

import pytest

from smokelake.plans import ORACLES, QUERIES

from .compare import connection, duck_rows, spark_rows
from .conftest import DATA


@pytest.fixture(scope="module")
def duck():
    return connection(DATA)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = spark_rows(QUERIES[name](spark, DATA))
    if name in ORACLES:
        assert got == duck_rows(duck, ORACLES[name])
    else:
        assert got[0]


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns
