"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.binding import let
from marlstone.operators.tables import scratch, written

__all__ = ["WORD", "few", "let", "load", "scratch", "words", "written"]

#: Words of every contract: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes up to which a written table is broadcast.
BROADCAST_BYTES = 64 << 20


def words(text: Column) -> Column:
    """The words of a text; null and white-space-only texts have none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def few(df: DataFrame, row_bytes: int = 16) -> DataFrame:
    """df, broadcast if its counted rows stay under BROADCAST_BYTES; otherwise Spark joins it as it likes."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
