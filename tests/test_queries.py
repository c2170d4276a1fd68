import pytest
from oracle import available, compare

from meterline.plans.queries import QUERIES, SQL

pytestmark = pytest.mark.skipif(not available(), reason="driver tables are absent")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name])


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
