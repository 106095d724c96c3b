"""Every registered query against its SQL on the smallest tables."""

import pytest

from chronofold import catalogue

catalogue.load()


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(name, spark, sf, duck, same):
    same(catalogue.QUERIES[name](spark, sf).toPandas(), duck(catalogue.ORACLES[name]))


def test_queries_without_sql(spark, sf):
    assert catalogue.QUERIES["seeded_sample"](spark, sf).count() == 500
    assert sorted(map(tuple, catalogue.QUERIES["seeded_sample"](spark, sf).collect())) == sorted(map(tuple, catalogue.QUERIES["seeded_sample"](spark, sf).repartition(7).collect()))
    assert {r["split"] for r in catalogue.QUERIES["model_scores"](spark, sf).collect()} == {"train", "validation", "test"}


def test_entry(spark):
    import __spark_entry__ as e

    from chronofold.schemas import check_contract

    df = e.entry(spark)
    check_contract(df.dtypes, 30)
    assert df.count() == 6000
    assert set(e.oracle_sql()) <= set(e.queries())
