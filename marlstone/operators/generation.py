"""Generation over a table: each different prompt once, in blocks, with a log that a restarted job goes on from.

A prompt is known by a digest of the model, the schema and its text. Digests that the
log has are answered from it; the others are sent in blocks of about BLOCK, and each
block's answers are appended to the log as one write before the next block starts. So
a job that dies sends again at most what its last block had not written, and a task
that is lost repeats its own part of one block: delivery is at least once within a
block, and once beyond it. A token budget is shared by all tasks: it is compared with
what the log says was spent before each block, so a run ends with the block that
reaches it, and the rest is left open.

Skew: rows with one prompt meet only as digests and are joined back plainly; blocks
are made of digests, so a hot prompt is one request.

Defined results: null prompts get no answer and are not sent; a request that fails for
good is logged with its error and not sent again, one that may succeed later is left
open. Rows without an answer have a null text, whose reason says why.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.ports import Generator, ProviderError
from marlstone.operators.tables import written

BLOCK = 10_000
LOG = "digest string, text string, stop string, error string, input_tokens bigint, output_tokens bigint, cost double"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A row for each digest; of two that were stored for one, the lesser text."""
    try:
        each = spark.read.schema(LOG).parquet(path)
    except AnalysisException:  # nothing was generated yet
        each = spark.createDataFrame([], LOG)
    return each.dropDuplicates(["digest", "text"]).groupBy("digest").agg(F.min(F.struct("text", "stop", "error", "input_tokens", "output_tokens", "cost")).alias("a")).select("digest", "a.*")


def generate_table(rows: DataFrame, generator: Generator, log: str, id_col: str = "id", prompt_col: str = "prompt", schema: Mapping | None = None, budget: int | None = None, block: int = BLOCK) -> DataFrame:
    """id, digest, text, stop, reason, input_tokens, output_tokens, cost of each row. budget: tokens that all requests of the log may have used."""
    spark = rows.sparkSession
    asked = F.col(prompt_col)
    mark = F.lit(f"{generator.id}\u0001{generator.model}\u0001{json.dumps(schema, sort_keys=True)}\u0001")
    keyed = written(rows.select(F.col(id_col).alias("id"), F.when(asked.isNotNull(), F.sha2(F.concat(mark, asked), 256)).alias("digest"), asked.alias("prompt")), "prompts")
    missing = keyed.where("digest is not null").join(read_log(spark, log).select("digest"), "digest", "left_anti").groupBy("digest").agg(F.min("prompt").alias("prompt"))
    missing = written(missing, "missing-prompts")
    blocks = -(-missing.count() // block)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for digest, prompt in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    got = generator.generate(prompt, dict(schema) if schema else None)
                    out.append((digest, got.text, got.stop, None, got.input_tokens, got.output_tokens, got.cost))
                except ProviderError as error:
                    if not error.retryable:
                        out.append((digest, None, None, str(error), 0, 0, 0.0))
            columns = zip(*out) if out else [[] for _ in LOG.split(", ")]
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], [c.split(" ")[0] for c in LOG.split(", ")])

    for k in range(blocks):
        if budget is not None and _spent(spark, log) >= budget:
            break
        part = missing.where(F.pmod(F.xxhash64("digest"), F.lit(blocks)) == k).repartition(spark.sparkContext.defaultParallelism)
        part.mapInArrow(send, LOG).write.mode("append").parquet(log)
    found = keyed.select("id", "digest").join(written(read_log(spark, log), "answers"), "digest", "left")
    reason = F.when(F.col("digest").isNull(), "no prompt").when(F.col("error").isNotNull(), F.col("error")).when(F.col("text").isNull(), "open")
    return found.select("id", "digest", "text", "stop", reason.alias("reason"), "input_tokens", "output_tokens", "cost")


def _spent(spark: SparkSession, log: str) -> int:
    return read_log(spark, log).agg(F.coalesce(F.sum(F.col("input_tokens") + F.col("output_tokens")), F.lit(0))).first()[0]
