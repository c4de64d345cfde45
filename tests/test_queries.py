"""Every query with SQL, against DuckDB over the smallest tables."""

import pytest

from corpusgraph.plans import catalogue
from tests.conftest import SMALL
from tests.duck import assert_same, connect


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, duck, name):
    assert_same(catalogue.QUERIES[name](spark, SMALL), catalogue.SQL[name], duck)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql(spark, name):
    assert catalogue.QUERIES[name](spark, SMALL).count() > 0


def test_entry_works_without_the_optional_parts():
    import __spark_entry__

    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["doc_id", "final_score", "place"]
