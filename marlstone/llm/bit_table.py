"""Membership of hashes in a bit table that tasks test in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import written

#: Bits of a table for each hash, before rounding up to a power of two.
BITS_A_HASH = 48
#: A table is never larger; with more hashes it lets more others through, and never keeps one of its own out.
MOST_BITS = 1 << 27


class BitTable:
    """Two bits for each hash in an array of bigints, as a one-row table that a scalar subquery reads.

    Words are made by bit_or in parallel; one task only strings the words together,
    at most MOST_BITS / 64 of them.
    """

    def __init__(self, hashes: DataFrame, name: str):
        """hashes: one column, hash."""
        own = written(hashes.distinct(), f"{name}-hashes")
        self.bits = min(MOST_BITS, 1 << max(12, int(own.count() * BITS_A_HASH - 1).bit_length()))
        at = own.select(F.explode(F.array(F.col("hash"), F.shiftrightunsigned("hash", 32))).alias("h")).select(F.col("h").bitwiseAND(F.lit(self.bits - 1)).alias("at"))
        word = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(self._bit(F.col("at"))).alias("bits"))
        whole = own.sparkSession.range(self.bits // 64).withColumnRenamed("id", "word").join(word, "word", "left").select("word", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))
        self.table = written(whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words")), f"{name}-bits")

    @staticmethod
    def _bit(at: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(F.lit(63)).cast("int"))

    def holds(self, words: Column, h: Column) -> Column:
        """True if both bits of a hash are set; words: the table's array."""

        def at(x: Column) -> Column:
            place = x.bitwiseAND(F.lit(self.bits - 1))
            return F.get(words, F.shiftright(place, 6).cast("int")).bitwiseAND(self._bit(place)) != 0

        return at(h) & at(F.shiftrightunsigned(h, 32))
