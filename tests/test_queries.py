"""Every query against its SQL; queries without SQL must run and give rows."""

import pytest

from folioscope.plans import registry

from .conftest import rows_of, rows_of_sql


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, sf_dir, duck):
    got = rows_of(registry.QUERIES[name](spark, sf_dir))
    if name in registry.SQL:
        assert got == rows_of_sql(duck, registry.SQL[name])
    assert got[1]


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
