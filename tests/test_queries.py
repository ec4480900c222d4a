import pytest

from graphloom.plans.queries import ORACLES, QUERIES

from .conftest import same_rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        same_rows(df, duck, ORACLES[name])
    else:
        assert df.count() > 0


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 100
    assert set(entry.oracle_sql()) <= set(entry.queries())
