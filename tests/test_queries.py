"""Every registered query against its SQL, on the smallest tables."""

import pytest
from oracle import connect, difference

from chainlake.plans import load

QUERIES, SQL = load()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert len(set(df.columns)) == len(df.columns)
    if name in SQL:
        assert difference(df, con, SQL[name]) is None
    else:
        assert df.count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_point(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["chain_id", "entries", "head", "ok"]
    assert df.filter("NOT ok").count() == 0
