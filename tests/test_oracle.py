"""Every registered query against its oracle SQL on the smallest test data."""

import pytest

import __spark_entry__ as entry
from check_oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLES:
        assert rows
        return
    cur = duck.execute(ORACLES[name])
    problem = compare(df.columns, rows, [d[0] for d in cur.description], cur.fetchall())
    assert problem is None, problem


def test_entry(spark):
    assert entry.entry(spark).count() == 4
