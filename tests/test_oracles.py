import pytest

from curaspark.plans.oracles import ORACLES
from curaspark.plans.queries import QUERIES

from .compare import assert_same, views


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, data, name):
    assert_same(QUERIES[name](spark, data).toPandas(), views(data).sql(ORACLES[name]).fetchdf())


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(ORACLES) == {"spherical_kmeans_fit"}  # an iterative fit


@pytest.mark.parametrize("name", ["review_order", "embedding_row", "canonical_cluster_ids"])
def test_partition_count_does_not_matter(spark, data, name):
    got = []
    for n in ("1", "4", "32"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(QUERIES[name](spark, data).toPandas())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert_same(got[0], got[1])
    assert_same(got[0], got[2])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1295
    assert set(entry.oracle_sql()) <= set(entry.queries())
