import pytest
from oracle import check

from gristmill.llm.queries import QUERIES
from gristmill.llm.sql import SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(name, spark, data):
    check(QUERIES[name], SQL[name], spark, data)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(name, spark, data):
    assert QUERIES[name](spark, data).count() > 0
