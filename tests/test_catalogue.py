"""Every named query against the same query in SQL."""

import pytest
from tests.conftest import compare

from tessera import catalogue, catalogue_store

QUERIES = catalogue.QUERIES | catalogue_store.QUERIES
ORACLE_SQL = catalogue.ORACLE_SQL | catalogue_store.ORACLE_SQL


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, sf_dir, duck):
    rows = QUERIES[name](spark, sf_dir).toPandas()
    compare(rows, duck.execute(ORACLE_SQL[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and not set(catalogue.QUERIES) & set(catalogue_store.QUERIES)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
