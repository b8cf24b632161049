"""Every query with an SQL counterpart must give the same rows."""

import pytest

from tests.conftest import SF
from catalog.queries import QUERIES
from catalog.wide_oracle import ORACLE
from tools.check_oracle import compare, duck


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLE[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_other_queries_give_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    from __spark_entry__ import entry

    rows = {r["dataset"]: r for r in entry(spark).collect()}
    assert rows["real"]["upsilon_mean"] > rows["base"]["upsilon_mean"]
