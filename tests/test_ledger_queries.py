import pytest

from ledgerloom.plans.queries import oracle_sql, queries
from oracle import connection, differs


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", list(queries()))
def test_equals_sql(spark, con, name):
    assert differs(spark, queries()[name], oracle_sql()[name], con) is None
