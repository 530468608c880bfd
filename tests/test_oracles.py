"""Every registered query that SQL can express gives the rows that SQL gives."""

import pytest

from corpuslink.plans import registry
from helpers import rows_of, rows_of_sql

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, small, name):
    got, want = rows_of(registry.queries()[name](spark, small)), rows_of_sql(SQL[name], small)
    assert got[0] == want[0]
    assert got[1] == want[1]
