"""The outbox as a stream: files of events in, results out, at least once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlstone.operators.events import MAX_ATTEMPTS, TYPES

SCHEMA = "id string, tenant_id string, type string, payload string, available_at timestamp, attempts int"
#: Payload parts without which an event of a type is dead at once.
NEEDED = {"document.uploaded": ("documentId", "storageKey", "filename"), "source.sync.requested": ("sourceId",), "knowledge.gap": ("question", "reason")}


def publish(events: DataFrame, path: str) -> None:
    events.select(*[c.split(" ")[0] for c in SCHEMA.split(", ")]).write.mode("append").parquet(path)


def valid(events: DataFrame) -> DataFrame:
    """events with the reason why they can never be handled, or null."""
    why = F.when(~F.col("type").isin(*TYPES), F.lit("unknown type"))
    for kind, parts in NEEDED.items():
        lacks = F.lit(False)
        for p in parts:
            lacks = lacks | (F.coalesce(F.get_json_object("payload", f"$.{p}"), F.lit("")) == "")
        why = why.when((F.col("type") == kind) & lacks, F.lit("payload lacks a part"))
    return events.withColumn("invalid", why)


def drain(spark: SparkSession, path: str, out: str, checkpoint: str, handlers: dict[str, Callable[[DataFrame], DataFrame]]) -> StreamingQuery:
    """Each micro-batch goes to its types' handlers, which return id and error (null: done); results are written by batch.

    The checkpoint stands for leases and locks: a batch that was not finished is
    run again, and overwrites its own results. Types without a handler are done.
    """

    def batch(events: DataFrame, number: int) -> None:
        at = valid(events).persist()
        done = at.where("invalid is null and type not in ({})".format(", ".join(f"'{t}'" for t in handlers) or "''")).select("id", F.lit("DONE").alias("status"), F.lit(None).cast("string").alias("error"))
        done = done.unionByName(at.where("invalid is not null").select("id", F.lit("DEAD").alias("status"), F.col("invalid").alias("error")))
        for kind, handle in handlers.items():
            result = handle(at.where((F.col("type") == kind) & F.col("invalid").isNull()).drop("invalid")).join(at.select("id", "attempts"), "id")
            status = F.when(F.col("error").isNull(), "DONE").when(F.col("attempts") + 1 >= MAX_ATTEMPTS, "DEAD").otherwise("PENDING")
            done = done.unionByName(result.select("id", status.alias("status"), "error"))
        done.write.mode("overwrite").parquet(f"{out}/batch={number}")
        at.unpersist()

    stream = spark.readStream.schema(SCHEMA).parquet(path)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
