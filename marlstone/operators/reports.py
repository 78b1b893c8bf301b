"""List and detail queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bounded(n: int | None, default: int = 50, most: int = 200) -> int:
    return max(1, min(default if n is None else n, most))


def newest(rows: DataFrame, where: dict[str, str | None], order: list[Column], n: int | None = None) -> DataFrame:
    """The newest rows that have the given values; values that are None do not restrict."""
    for c, v in where.items():
        if v is not None:
            rows = rows.where(F.col(c) == v)
    return rows.orderBy(*order).limit(bounded(n))


def with_counts(rows: DataFrame, key: str, children: DataFrame, child_key: str, name: str) -> DataFrame:
    """rows with the number of their children, zero if there are none."""
    n = children.groupBy(F.col(child_key).alias(key)).agg(F.count(F.lit(1)).alias(name))
    return rows.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def with_latest(rows: DataFrame, key: str, children: DataFrame, child_key: str, order: list[Column], fields: list[str], n: int, name: str) -> DataFrame:
    """rows with an array of the n first children by order; an empty one if there are none."""
    at = children.withColumn("__n", F.row_number().over(Window.partitionBy(child_key).orderBy(*order))).where(F.col("__n") <= n)
    own = at.groupBy(F.col(child_key).alias(key)).agg(F.array_sort(F.collect_list(F.struct("__n", *fields))).alias(name))
    own = own.withColumn(name, F.transform(name, lambda x: F.struct(*[x[f].alias(f) for f in fields])))
    return rows.join(own, key, "left").withColumn(name, F.coalesce(name, F.array().cast(own.schema[name].dataType)))


def with_active_version(documents: DataFrame, versions: DataFrame) -> DataFrame:
    """documents with active_version (version, checksum, ingested_at), the newest if several are active; null if none is."""
    own = versions.where("is_active").groupBy(F.col("document_id").alias("id")).agg(F.max_by(F.struct("version", "checksum", "ingested_at"), "version").alias("active_version"))
    return documents.join(own, "id", "left")


def contact_problem(email: Column, phone: Column, external_id: Column, channel: Column) -> Column:
    """What is wrong with a contact; null if nothing is."""
    return F.when(email.isNull() & phone.isNull() & external_id.isNull(), "no identifier").when(external_id.isNotNull() & channel.isNull(), "external id without channel")


def source_transition(is_active: Column, status: Column) -> Column:
    """What asking a source to sync leads to."""
    return F.when(~is_active, "inactive").when(status.isin("PENDING", "RUNNING"), "already running").otherwise("PENDING")
