import pytest
from oracle import compare, connect

import __spark_entry__ as entry

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def engine(small):
    return connect(small)


def test_every_query_has_a_counterpart():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns and frame.count() > 0


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, small, engine, name):
    frame = entry.queries()[name](spark, small)
    if name in SQL:
        assert compare(frame, engine, SQL[name]) is None
    else:
        assert frame.count() > 0
