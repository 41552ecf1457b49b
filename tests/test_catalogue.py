"""Every query with SQL gives DuckDB's rows; every other one gives rows."""

import pytest

from tesserae.plans import catalogue

from .compare import rows


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_duckdb(spark, duck, sf_dir, name):
    got = catalogue.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(catalogue.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_gives_rows(spark, sf_dir, name):
    got = catalogue.QUERIES[name](spark, sf_dir)
    assert got.count() > 0


def test_entry_names(spark):
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 3
