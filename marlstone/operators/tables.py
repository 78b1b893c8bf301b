"""Tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of this machine in local mode, and an error on a cluster."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_made(jvm, settings) -> None:
    """Deletes this application's intermediate tables. The JVM outlives a stopped session, so neither needs one."""
    while _made:
        at = jvm.org.apache.hadoop.fs.Path(_made.pop())
        at.getFileSystem(settings).delete(at, True)


def scratch(spark: SparkSession, name: str, keep: bool = True) -> str:
    """A new path in the shared folder. Unless it is to be kept, it goes with the application."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not keep:
        if not _made:
            atexit.register(drop_made, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration())
        _made.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: a cut of the lineage that outlives executors. It is deleted when the application ends."""
    spark = df.sparkSession
    path = scratch(spark, name, keep=False)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
