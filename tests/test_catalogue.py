"""Every query runs; those with SQL agree with it."""

import pytest
from oracle import compare

from rankloom.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_agrees_with_sql(spark, sf_dir, name):
    compare(spark, sf_dir, catalogue.QUERIES[name], catalogue.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_runs(spark, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark, sf_dir):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["query_id", "chunk_id", "rank", "score"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
