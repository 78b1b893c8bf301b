"""Probed cells as partition filters of the scan, whatever numbers Spark gives to columns."""

import re

import numpy as np
from pyspark.sql.types import LongType

from marlstone.operators.vector_index import VectorIndex


def test_scan_has_probed_cells_as_partition_filter(spark):
    new = spark._jvm.org.apache.spark.sql.catalyst.expressions.NamedExpression
    while new.newExprId().id() < 20_000:
        pass
    rng = np.random.default_rng(5)
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.normal(size=(200, 6)))], "id bigint, embedding array<double>")
    index = VectorIndex.build(vectors, cells=8)
    q = np.array([vectors.first().embedding])
    q /= np.linalg.norm(q)
    probed = np.zeros((1, 8), bool)
    probed[0, index.cells_of(q)[0, :2]] = True
    plan = index._scan([0], q, 5, probed, LongType())._jdf.queryExecution().executedPlan().toString()
    found = re.search(r"PartitionFilters: \[[^\]]*cell#(\d+) IN \((\d+),(\d+)\)", plan)
    assert found and int(found[1]) >= 20_000
    assert sorted(map(int, found.groups()[1:])) == np.flatnonzero(probed[0]).tolist()
