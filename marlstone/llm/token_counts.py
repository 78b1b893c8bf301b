"""Token counts through a digest cache.

Texts are keyed by the SHA-256 of their normalised content and by the digest of
the tokenizer's file. A stored count answers for every text with that key; only
one text of each key that has none is encoded, and its count is appended; all
counts are then read from the cache. Normalising makes each run of ASCII white
space one space and trims; a tokenizer must give equal counts for that, which is
tested before anything is counted.

Texts stay where they are read: which rows to leave out is decided on digests, and
a bit table of them clears all other rows in place. Only rows that the table holds
(copies, known texts, and one in a thousand others) are compared with the rows to
leave out themselves. The table is bounded, so on a corpus with over ten million
rows to leave out it clears fewer, and at worst each text is shuffled once.

Skew: copies meet only as 40-byte keys, aggregated before they are shuffled, and
the rows of a hot key are joined with a written table, which adaptive execution
splits. Defined results: a null text counts as empty (no tokens); texts of any
length are counted whole; repeated rows and repeated or null ids each keep their
row. An empty table gives no rows and appends nothing to the cache. Only the two
named columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.bit_table import BitTable
from marlstone.llm.chunk_encoder import CountEncoder, encoder
from marlstone.llm.common import load, scratch, written

CACHE = "tokenizer string, digest binary, n_tokens bigint"
#: Texts whose counts may not depend on white space: what content_digest() takes for equal.
PROBES = (("a b", " a \n\tb "), ("One, two.", "One,\r\ntwo.  "), ("été 12 x", "été\x0b12\x0c x"))


def content_digest(text: Column) -> Column:
    """Of the normalised content. White space that patterns call \\s beyond ASCII stays as it is."""
    return F.unhex(F.sha2(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")), 256))


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()[:16]


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """digest, n_tokens: one row for each digest, however often runs at once or a repeated append have stored it. Counts that differ are an error."""
    try:
        kept = spark.read.schema(CACHE).parquet(path)
    except AnalysisException:  # no cache yet
        kept = spark.createDataFrame([], CACHE)
    each = kept.where(F.col("tokenizer") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"), F.max("n_tokens").alias("most"))
    differ = F.assert_true(F.col("n_tokens") == F.col("most"), F.lit("the cache has different counts for one digest")).isNull()
    return each.where(differ).select("digest", "n_tokens")


def _checked(tokenizer_path: str) -> str:
    """The tokenizer's digest; an error if white space counts."""
    counter = encoder(CountEncoder, tokenizer_path)
    if any(len(counter.whole(x)) != len(counter.whole(y)) for x, y in PROBES):
        raise ValueError("digests of normalised content need a tokenizer that drops white space")
    return tokenizer_digest(tokenizer_path)


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and n_tokens for each row of docs; cache_path gains what was missing."""
    spark = docs.sparkSession
    version = _checked(tokenizer_path)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("digest", content_digest(F.col("text")))
    keyed = written(texts.select("doc_id", "digest", F.octet_length("text").cast("bigint").alias("n_bytes")), "digests")
    known = read_cache(spark, cache_path, version)
    # One row stands for each missing digest; the other rows that have it, or a known one, are left out.
    holders = written(keyed.groupBy("digest").agg(F.min("doc_id").alias("holder"), F.count(F.lit(1)).alias("n")).where("n > 1"), "holders")
    left_out = written(
        keyed.join(holders, "digest").where(~F.col("doc_id").eqNullSafe(F.col("holder"))).select("digest", "doc_id")
        .unionByName(keyed.join(known, "digest", "left_semi").select("digest", "doc_id")),
        "left-out",
    )
    table = BitTable(left_out.select(F.xxhash64("digest").alias("hash")), "left-out")
    at = texts.select("*", table.table.scalar().alias("words"))
    maybe = table.holds(F.col("words"), F.xxhash64("digest"))
    skip = left_out.alias("skip")
    held = at.where(maybe).select("doc_id", "digest", "text").alias("at")
    misses = at.where(~maybe).select("digest", "text").unionByName(
        held.join(skip, (F.col("at.digest") == F.col("skip.digest")) & F.col("at.doc_id").eqNullSafe(F.col("skip.doc_id")), "left_anti").select("at.digest", "at.text")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = encoder(CountEncoder, tokenizer_path)
        for batch in batches:
            n = pa.array([counter.count(t) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], ["digest", "n_tokens"])

    counted = misses.mapInArrow(count, "digest binary, n_tokens bigint").dropDuplicates(["digest"])
    counted.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache_path)
    stored = read_cache(spark, cache_path, version)
    return keyed.join(stored, "digest", "left").select("doc_id", "n_bytes", "n_tokens")


def op2_token_counts(spark: SparkSession, sf_dir: str, max_tokens: int = 2048, cache_path: str | None = None) -> DataFrame:
    """cache_path: where counts are kept from run to run; a new one if None, so that a run's work does not depend on earlier ones."""
    import public_tokenizers

    counts = token_counts(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), cache_path or scratch(spark, "token-counts"))
    return counts.withColumn("over_limit", F.col("n_tokens") > max_tokens)
