"""Every registered query on the smallest data: SQL where there is some, rows elsewhere."""

import pytest

from tesserae.llm import registry

from ..compare import rows


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_duckdb(spark, duck, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(registry.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_names():
    import __spark_entry__ as entry

    assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in registry.QUERIES}
    assert set(registry.QUERIES) | {"pipeline"} <= set(entry.queries())
