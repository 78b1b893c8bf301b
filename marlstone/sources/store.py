"""A file store as an append-only table: what was put and deleted, and the current view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from marlstone.functions import text as tx

SCHEMA = "key string, content binary, deleted boolean, version bigint"


class StorageError(ValueError):
    pass


class FileStore:
    """put, get, delete and exists over sets of keys. Nothing is overwritten: the row with the highest version is a key's state.

    Keys are path segments that neither hide nor go up; a batch with any other key
    is refused whole. Versions are given by the caller (a batch number, a time), so
    that a repeated write gives the same state.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _append(self, rows: DataFrame) -> None:
        if bad := rows.where(~F.coalesce(tx.valid_storage_key(F.col("key")), F.lit(False))).select("key").limit(3).collect():
            raise StorageError(f"not a key: {[r.key for r in bad]}")
        rows.write.mode("append").parquet(self.path)

    def _log(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException:  # nothing was put yet
            return self.spark.createDataFrame([], SCHEMA)

    def put(self, files: DataFrame, version: int) -> None:
        """files: key, content. A key may stand once in a batch."""
        self._append(files.select("key", F.col("content").cast("binary").alias("content"), F.lit(False).alias("deleted"), F.lit(version).cast("bigint").alias("version")))

    def delete(self, keys: DataFrame, version: int) -> None:
        """Keys that are not there are no error."""
        self._append(keys.select("key", F.lit(None).cast("binary").alias("content"), F.lit(True).alias("deleted"), F.lit(version).cast("bigint").alias("version")))

    def _state(self, value: Column) -> DataFrame:
        newest = self._log().groupBy("key").agg(F.max_by(F.struct("deleted", value.alias("content")), "version").alias("s"))
        return newest.where("not s.deleted").select("key", F.col("s.content").alias("content"))

    def get(self, keys: DataFrame) -> DataFrame:
        """key, content of those keys that are there."""
        return self._state(F.col("content")).join(keys.select("key").distinct(), "key", "left_semi")

    def exists(self, keys: DataFrame) -> DataFrame:
        """key, there. Contents are not read."""
        at = self._state(F.lit(True)).select("key", F.lit(True).alias("there"))
        return keys.select("key").distinct().join(at, "key", "left").select("key", F.coalesce("there", F.lit(False)).alias("there"))
