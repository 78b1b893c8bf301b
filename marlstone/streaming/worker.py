"""A worker over the outbox: handlers, retries with backoff, dead letters, in files that survive restarts.

Under one folder stand queue (events as they were published, and again for each
retry), results (one row for each attempt, by status), and the stream's checkpoint.
A cycle first puts failed events that are due back into the queue, as rows with their
attempts counted, then drains the queue. Every step can be repeated: a retry is known
by its event and attempt and is queued once, a batch that was not finished runs again
under its number and overwrites its own results. Delivery is at least once.

Handlers of a type run in order over sets of events; an event that one of them fails
is not shown to the next. A failed event waits twice as long each time, and is dead
after MAX_ATTEMPTS or if the failure is permanent. Types without a handler are done.

Only results that wait are read to find what is due, as results are partitioned by
status; a retry that was queued is recognised by the queue's retries alone.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.events import MAX_ATTEMPTS, backoff_ms
from marlstone.streaming.outbox import SCHEMA, valid

#: events (without `invalid`) to id, error (null: done), and optionally permanent
Handler = Callable[[DataFrame], DataFrame]
RESULT = SCHEMA + ", error string, status string"
_EVENT = [c.split(" ")[0] for c in SCHEMA.split(", ")]


@dataclass
class Worker:
    spark: SparkSession
    root: str
    handlers: dict[str, list[Handler]] = field(default_factory=dict)
    max_attempts: int = MAX_ATTEMPTS

    def on(self, kind: str, handle: Handler) -> Worker:
        self.handlers.setdefault(kind, []).append(handle)
        return self

    def publish(self, events: DataFrame) -> None:
        """events: id, tenant_id, type, payload, and optionally available_at; they have not been tried."""
        at = F.col("available_at") if "available_at" in events.columns else F.lit(None)
        rows = events.select("id", "tenant_id", "type", "payload", at.cast("timestamp").alias("available_at"), F.lit(0).alias("attempts"))
        rows.write.mode("append").parquet(f"{self.root}/queue/new")

    def _read(self, folder: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{folder}")
        except AnalysisException:  # nothing was written yet
            return self.spark.createDataFrame([], schema)

    def results(self) -> DataFrame:
        """An event's attempts: its columns with attempts as they are after it, error, status, and when it is due again."""
        return self._read("results", RESULT + ", batch bigint")

    def due(self, now: Column) -> DataFrame:
        """Failed events whose time has come and that are not queued again yet."""
        waiting = self.results().where((F.col("status") == "PENDING") & (F.col("available_at") <= now)).select(*_EVENT)
        return waiting.join(self._read("queue/retry", SCHEMA).select("id", "attempts"), ["id", "attempts"], "left_anti").dropDuplicates(["id", "attempts"])

    def requeue(self, now: Column) -> None:
        self.due(now).select(*_EVENT).write.mode("append").parquet(f"{self.root}/queue/retry")

    def _handled(self, events: DataFrame, now: Column) -> DataFrame:
        """RESULT rows of a batch of events."""
        at = valid(events)
        lasting = at.where("invalid is not null").select(*_EVENT, F.col("invalid").alias("error"), F.lit(True).alias("permanent"))
        good = at.where("invalid is null").drop("invalid")
        for kind in {t for t, own in self.handlers.items() if own}:
            going = good.where(F.col("type") == kind)
            for handle in self.handlers[kind]:
                told = handle(going)
                never = F.coalesce(F.col("permanent"), F.lit(False)) if "permanent" in told.columns else F.lit(False)
                failed = told.where("error is not null").groupBy("id").agg(F.min("error").alias("error"), F.max(never).alias("permanent"))
                failed = failed.persist()  # read for what failed and for what goes on
                lasting = lasting.unionByName(going.join(failed, "id").select(*_EVENT, "error", "permanent"))
                going = going.join(failed, "id", "left_anti")
            good = good.where(F.col("type") != kind).unionByName(going)
        done = good.select(*_EVENT, F.lit(None).cast("string").alias("error"), F.lit(False).alias("permanent"))
        tried = lasting.unionByName(done).withColumn("attempts", F.col("attempts") + 1)
        status = F.when(F.col("error").isNull(), "DONE").when(F.col("permanent") | (F.col("attempts") >= self.max_attempts), "DEAD").otherwise("PENDING")
        jitter = F.pmod(F.xxhash64("id", "attempts"), F.lit(1000)) / 1000  # the same if the batch runs again
        again = F.timestamp_millis((F.unix_millis(now) + backoff_ms(F.col("attempts"), jitter)).cast("bigint"))
        return tried.withColumn("status", status).withColumn("available_at", F.when(F.col("status") == "PENDING", again)).select(*_EVENT, "error", "status")

    def drain(self, now: Column) -> None:
        """Takes everything that is queued."""

        def batch(events: DataFrame, number: int) -> None:
            # an event that is queued twice, or again after its batch was lost, is one event
            fresh = events.dropDuplicates(["id", "attempts"]).persist()
            self._handled(fresh, now).write.mode("overwrite").partitionBy("status").parquet(f"{self.root}/results/batch={number}")
            self.spark.catalog.clearCache()

        stream = self.spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{self.root}/queue")
        stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    def cycle(self, now: Column | None = None) -> None:
        now = F.current_timestamp() if now is None else now
        self.requeue(now)
        self.drain(now)

    def run(self, seconds: float = 2.0, goes_on: Callable[[], bool] = lambda: True) -> None:
        """Cycles until goes_on() says no."""
        while goes_on():
            self.cycle()
            time.sleep(seconds)

    def states(self) -> DataFrame:
        """id, status, attempts, error of each event that was published: its last attempt, or PENDING while one is queued."""
        queued = self.spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{self.root}/queue")
        each = queued.select("id", "attempts", F.lit("PENDING").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(1).alias("later"))
        each = each.unionByName(self.results().select("id", "attempts", "status", "error", F.lit(0).alias("later")))
        # a retry that is queued with n attempts comes after the result of attempt n
        last = each.groupBy("id").agg(F.max_by(F.struct("status", "attempts", "error"), F.struct("attempts", "later")).alias("s"))
        return last.select("id", "s.status", "s.attempts", "s.error")
