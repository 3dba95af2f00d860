import pytest

from refrain.plans import queries as q

from .oracle import same

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_query_equals_its_sql(spark, name):
    same(q.QUERIES[name], q.ORACLE[name], spark, DATA)


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLE)))
def test_query_runs(spark, name):
    assert q.QUERIES[name](spark, DATA).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
