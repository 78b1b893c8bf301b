"""The worker over restarts: retries, dead letters, chains, and batches that ran twice."""

import datetime as dt
import os
import shutil

import pytest
from pyspark.sql import functions as F

from marlstone.streaming.worker import Worker

EVENT = "id string, tenant_id string, type string, payload string"
START = dt.datetime(2026, 1, 2, 3, 4, 5)
GAP = '{"question": "q", "reason": "NO_RESULTS"}'


def at(minutes):
    return F.lit((START + dt.timedelta(minutes=minutes)).isoformat(sep=" ")).cast("timestamp")


def failing(events):
    """The number in an id is how often it fails; "never" always does."""
    times = F.coalesce(F.regexp_extract("id", r"fails-(\d+)", 1).try_cast("int"), F.lit(0))
    times = F.when(F.col("id").startswith("never"), 99).otherwise(times)
    return events.select("id", F.when(F.col("attempts") < times, F.concat(F.lit("attempt "), (F.col("attempts") + 1).cast("string"))).alias("error"))


def worker(spark, root, handle=failing):
    return Worker(spark, f"file://{root}").on("knowledge.gap", handle)


def states(w):
    return {r.id: (r.status, r.attempts) for r in w.states().collect()}


def test_retries_over_restarts(spark, tmp_path):
    rows = [(i, "t", "knowledge.gap", GAP) for i in ("fails-0", "fails-2", "never-1")] + [("no handler", "t", "message.sent", "{}"), ("bad", "t", "knowledge.gap", "{}"), ("unknown", "t", "what", "{}")]
    worker(spark, tmp_path).publish(spark.createDataFrame(rows, EVENT))
    worker(spark, tmp_path).cycle(at(0))
    got = states(worker(spark, tmp_path))
    assert got == {"fails-0": ("DONE", 1), "fails-2": ("PENDING", 1), "never-1": ("PENDING", 1), "no handler": ("DONE", 1), "bad": ("DEAD", 1), "unknown": ("DEAD", 1)}
    worker(spark, tmp_path).cycle(at(0))  # nothing is due yet
    assert states(worker(spark, tmp_path)) == got

    def broken(events):
        raise RuntimeError("the process dies here")

    with pytest.raises(Exception, match="dies here"):  # the batch of the second attempts is lost
        worker(spark, tmp_path, broken).cycle(at(10))
    assert states(worker(spark, tmp_path))["fails-2"] == ("PENDING", 1)
    for k in range(2, 8):
        worker(spark, tmp_path).cycle(at(10 * k))
    w = worker(spark, tmp_path)
    assert states(w) == got | {"fails-2": ("DONE", 3), "never-1": ("DEAD", 5)}
    tried = sorted((r.id, r.attempts, r.status, r.error) for r in w.results().where("id in ('fails-2', 'never-1')").collect())
    assert tried == [("fails-2", 1, "PENDING", "attempt 1"), ("fails-2", 2, "PENDING", "attempt 2"), ("fails-2", 3, "DONE", None), *[("never-1", k, "DEAD" if k == 5 else "PENDING", f"attempt {k}") for k in range(1, 6)]]


def test_a_batch_that_was_written_but_not_committed_runs_again(spark, tmp_path):
    w = worker(spark, tmp_path)
    w.publish(spark.createDataFrame([("fails-1", "t", "knowledge.gap", GAP)], EVENT))
    w.cycle(at(0))
    shutil.rmtree(tmp_path / "checkpoint/commits")  # as if the process had died between the two
    os.mkdir(tmp_path / "checkpoint/commits")
    w.cycle(at(1))
    w.cycle(at(20))
    assert states(w) == {"fails-1": ("DONE", 2)} and w.results().count() == 2


def test_retries_are_queued_once(spark, tmp_path):
    w = worker(spark, tmp_path)
    w.publish(spark.createDataFrame([("never-1", "t", "knowledge.gap", GAP)], EVENT))
    w.cycle(at(0))
    for _ in range(3):
        w.requeue(at(10))
    assert spark.read.parquet(f"{tmp_path}/queue/retry").count() == 1 and w.due(at(10)).count() == 0


def test_handlers_in_order(spark, tmp_path):
    seen = []

    def second(events):
        seen.append(sorted(r.id for r in events.collect()))
        return events.select("id", F.when(F.col("id") == "bad-2", "stops").alias("error"), F.lit(True).alias("permanent"))

    def first(events):
        return events.select("id", F.when(F.col("id") == "bad-1", "fails").alias("error"))

    w = Worker(spark, f"file://{tmp_path}").on("knowledge.gap", first).on("knowledge.gap", second)
    w.publish(spark.createDataFrame([(i, "t", "knowledge.gap", GAP) for i in ("good", "bad-1", "bad-2")], EVENT))
    w.cycle(at(0))
    assert states(w) == {"good": ("DONE", 1), "bad-1": ("PENDING", 1), "bad-2": ("DEAD", 1)} and seen[-1] == ["bad-2", "good"]
