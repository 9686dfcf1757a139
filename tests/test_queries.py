"""Every query of the engine that SQL can express, against DuckDB; the others run and have rows."""

import pytest
from conftest import SF, same_as_sql

from graphloom import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_rows_as_sql(spark, duck, name):
    same_as_sql(spark, duck, name)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
