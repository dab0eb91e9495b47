"""Every query of the core against its SQL, and those without SQL against their schema."""

import pytest
from conftest import DATA, rows_of, rows_of_sql

from aliasmith import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_is_its_sql(spark, duck, name):
    assert rows_of(queries.QUERIES[name](spark, DATA)) == rows_of_sql(duck, queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns[:3] == ["query_id", "rank", "alias"]
    assert set(e.oracle_sql()) <= set(e.queries())
