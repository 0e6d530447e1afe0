"""The subpackage's queries on the smallest data folder."""

import sys
from pathlib import Path

import pytest

queries = pytest.importorskip("archivolt.llm.queries")
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from oracle import FOLDER, database, differences, rows

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test data here")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, name):
    more, less = differences(queries.QUERIES[name](spark, str(FOLDER)), database(), queries.SQL[name])
    assert not more and not less


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - queries.SQL.keys()))
def test_runs(spark, name):
    """It gives rows, the same ones each time; what they have to be is tested in the operators' tests."""
    first, again = (rows(df.columns, map(tuple, df.collect())) for df in (queries.QUERIES[name](spark, str(FOLDER)) for _ in range(2)))
    assert first == again and (first or name.endswith("_found"))
