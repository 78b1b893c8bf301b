"""Token-ID output: documents' ids in grammar-compressed shard files.

Documents are dealt to shards by ranges of doc_id and stand in ascending order
in them. A shard is cut into blocks of whole documents, each with a grammar of
its own (repair_grammar.py); a file holds blocks as rows of Parquet, written by
Spark's committer, so a lost executor's files are never read, and any store that
Spark knows will do. Ids are dealt as text before they are encoded.

Defined results: a null or empty text has only its end id; texts of any length
are encoded whole; equal ids stand in the order of their texts' hashes, each with
a row of its own, and in one shard; null ids come first. An empty table gives an
empty file and no rows. Only the two named columns are read, so others may have
any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm import repair_grammar
from marlstone.llm.chunk_encoder import IdEncoder, encoder
from marlstone.llm.common import load, scratch

BLOCKS = "shard int, block int, n_docs int, n_tokens bigint, doc_ids array<bigint>, payload binary"
#: Tokens after which a block ends; a document that is longer has a block of its own.
BLOCK_TOKENS = 1 << 20
END_ID = 0


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> None:
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(IdEncoder, tokenizer_path)
        end = np.array([END_ID], "<u4")
        first_rule = ids.library.get_vocab_size(with_added_tokens=True)
        shard, number = TaskContext.get().partitionId(), 0
        names: list = []
        texts: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            nonlocal names, texts, n, number
            starts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
            g = repair_grammar.compress(np.concatenate([x for t in texts for x in (t, end)]), starts, first_rule)
            row = [shard, number, len(names), n, names, repair_grammar.pack(g)]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            names, texts, n, number = [], [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["shard", "block", "n_docs", "n_tokens", "doc_ids", "payload"])

        for batch in batches:
            for name, own in zip(batch.column(0).to_pylist(), chain.from_iterable(ids.columns(batch.column(1))), strict=True):
                if texts and n + len(own) + 1 > block_tokens:
                    yield flush()
                names.append(name)
                texts.append(own)
                n += len(own) + 1
        if texts:
            yield flush()

    ranged = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).repartitionByRange("doc_id")
    ordered = ranged.sortWithinPartitions(F.asc_nulls_first("doc_id"), F.xxhash64("text"))
    ordered.mapInArrow(blocks, BLOCKS).write.mode("overwrite").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, decoded from the files."""
    files = spark.read.schema(BLOCKS).parquet(path)
    sizes = files.select("shard", "block", "n_tokens")
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    shards = shards.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shard_start"))
    before = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("shard", "block", before.alias("block_start")).join(shards, "shard").select("shard", "block", (F.col("shard_start") + F.col("block_start")).alias("base"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, block, names, payload = (batch.column(k)[row].as_py() for k in range(4))
                g = repair_grammar.unpack(payload)
                ids = repair_grammar.expand(g, g.symbols)
                own = np.where(g.symbols < g.first_rule, 1, g.lengths[np.maximum(g.symbols.astype(np.int64) - g.first_rule, 0)] if len(g.lengths) else 1)
                cuts = np.concatenate([[0], np.cumsum(own)])[g.starts]
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                k = len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * k, pa.int32()), pa.array([block] * k, pa.int32()), pa.array(names, pa.int64()), pa.array(cuts[:-1], pa.int64()), pa.array(np.diff(cuts), pa.int64()), pa.array(crc, pa.int64())],
                    ["shard", "block", "doc_id", "offset", "n_tokens", "ids_crc32"],
                )

    rows = files.select("shard", "block", "doc_ids", "payload").mapInArrow(decode, "shard int, block int, doc_id bigint, offset bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(bases, ["shard", "block"]).select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer_path: str, path: str) -> DataFrame:
    write_token_files(docs, tokenizer_path, path)
    return read_token_files(docs.sparkSession, path)


def op10_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_output(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), scratch(spark, "token-files"))
