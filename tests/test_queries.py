import pytest

from oracle import same
from plumbline import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_duckdb(spark, small, name):
    same(spark, small, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL) - {"tsne_map"}))
def test_query_runs(spark, small, name):
    assert queries.QUERIES[name](spark, small).schema.fieldNames()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 80
    assert set(entry.oracle_sql()) <= set(entry.queries())
