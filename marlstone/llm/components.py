"""Connected components of a table of links, by alternating stars in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import written


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """links: a > b. Large: hang larger neighbours on the least one. Small: hang smaller neighbours and the node itself."""
    both = links.select("a", "b")
    if large:
        both = both.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # written, as a side that comes straight from a shuffle of its own keeps adaptive execution from splitting a hot key
    least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least-neighbours")
    hung = both.join(least, "a")
    if large:
        out = hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) links of bigints to (node, root): the least node that each node reaches; roots have no row.

    A round costs joins of the links with their written minima, a plain join whose
    hot keys adaptive execution splits, and rounds grow with the logarithm of a
    component's width. Only counts come to the driver. An empty table gives one.
    """
    now = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    before = None
    while True:
        n, mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not n or (n, mark) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = (n, mark)
        now = written(_stars(written(_stars(now, large=True), name), large=False), name)
