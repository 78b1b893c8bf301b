"""Usage by tenant, day and metric over a stream, with late entries up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily(entries: DataFrame, late: str = "1 day") -> DataFrame:
    """entries: tenant_id, at, metric, quantity, cost."""
    day = F.window("at", "1 day")
    sums = entries.withWatermark("at", late).groupBy("tenant_id", "metric", day).agg(F.sum("quantity").alias("quantity"), F.sum("cost").alias("cost"))
    return sums.select("tenant_id", F.to_date("window.start").alias("period_day"), "metric", "quantity", "cost")
