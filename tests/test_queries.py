"""Every registered query of the engine runs, and gives what its oracle gives."""

import pytest
from compare import same

from seamlight.plans import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", catalog.NAMES)
def test_query(spark, sf, name):
    df = catalog.queries()[name](spark, sf)
    if name in SQL:
        same(df, SQL[name], sf)
    else:
        assert df.count() > 0


def test_recall_gates(spark, sf):
    for row in catalog.ivf_recall(spark, sf).collect():
        assert row["recall"] >= 0.95
    assert catalog.lsh_recall(spark, sf).first()["recall"] >= 0.968


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
