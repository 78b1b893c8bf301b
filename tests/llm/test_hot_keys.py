"""Joins whose key is hot are split by adaptive execution."""

import pytest
from pyspark.sql import functions as F

from marlstone.llm import components as c


@pytest.fixture()
def splitting(spark):
    """Thresholds at which a million rows count as large."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256k", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_star_of_a_million_links(spark, splitting):
    star = spark.range(1, 1_000_001).select(F.lit(0).cast("bigint").alias("b"), F.col("id").alias("a"))
    others = spark.range(2_000_000, 2_200_000, 2).select((F.col("id") - 1).alias("b"), F.col("id").alias("a"))
    hung = c._stars(star.unionByName(others), large=True).agg(F.count(F.lit(1)).alias("n"))
    assert hung.collect()[0].n == 1_100_000
    assert "skew=true" in hung._jdf.queryExecution().executedPlan().toString()
    assert c.components(star.unionByName(others)).agg(F.count(F.lit(1)), F.countDistinct("root")).collect()[0] == (1_100_000, 100_001)
