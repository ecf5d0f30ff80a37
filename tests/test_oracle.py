"""Every registered query of the table library against its SQL, on the smallest tables."""

import os

import pytest

from tests.compare import differs, duck, sf
from tidemark.plans import registered

QUERIES, SQL = registered()
#: Queries whose answer has no rows on the smallest tables: nothing there is wrong, stale or missing. All others must give some.
EMPTY: set[str] = set()
pytestmark = pytest.mark.skipif(not os.path.isdir(sf()), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duck(sf())
    c.sql("SET TimeZone = 'UTC'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    assert differs(spark, con, sf(), QUERIES[name], SQL[name]) in (("", "no rows") if name in EMPTY else ("",))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, sf()).count() > 0


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)
