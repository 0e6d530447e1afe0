"""Every core query on the smallest data folder: against its SQL, or that it runs."""

import pytest

from archivolt.queries.registry import QUERIES, SQL
from oracle import FOLDER, database, differences, rows

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test data here")


@pytest.fixture(scope="module")
def con():
    return database()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    more, less = differences(QUERIES[name](spark, str(FOLDER)), con, SQL[name])
    assert not more and not less


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(spark, name):
    """It gives rows, the same ones each time; what they have to be is tested in the operators' tests."""
    first, again = (rows(df.columns, map(tuple, df.collect())) for df in (QUERIES[name](spark, str(FOLDER)) for _ in range(2)))
    assert first and first == again


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
