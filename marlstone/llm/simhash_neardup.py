"""SimHash near-duplicates with pigeonring candidates.

A fingerprint's bits are dealt to a ring of m segments. If two fingerprints
differ in at most t bits, there is a segment from which every chain of l
consecutive segments has at most l*t/m differences. The first segments of such
a chain, as long as the budget is below one, are equal, so they are the join
key; longer chains are then checked one by one within their budgets, and the
last chain, the whole ring, is the full Hamming distance.

Copies share a fingerprint and are one row from the start. A key that many
different fingerprints have (near copies of one text) would make pairs with the
square of their number; beyond DENSE fingerprints such a bucket is linked
through the points at distance one instead: two fingerprints differ in at most
two bits exactly if some point is within one bit of both, and a point has no
more such neighbours than there are bits. This keeps all links, in proportion to
the number of fingerprints, and holds for t = 2; for a larger t buckets are
joined in full.

Defined results: a text without words has fingerprint zero and links like any
other; null texts have no words; texts of any length are hashed whole; repeated
rows are copies and each have a row. A null id is nobody's component_id unless its
whole component has null ids. An empty table gives no rows. Only id and text are
read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import load, written
from marlstone.llm.components import components

BITS = 64
#: Distinct fingerprints up to which all pairs of a bucket are looked at.
DENSE = 48


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of all word shingles, repeats included, A-Z lowered; fewer words are one shingle, none has none."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z, and six white-space characters
    if not w:
        return np.zeros(0, "<u8")
    joined = b" ".join(w)
    width = min(width, len(w))
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(w) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], "<u8")


def majority(h: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 1 << 15):
        part = h[k : k + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = 3) -> int:
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed number."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col)).mapInArrow(of, "doc_id bigint, fp bigint")


def ring(segments: int, distance: int) -> tuple[list[list[int]], list[int]]:
    """masks[i][l - 1]: bits of the chain of l segments from i, as signed numbers; budget[l - 1]."""
    cuts = [BITS * k // segments for k in range(segments + 1)]
    own = [sum(1 << b for b in range(cuts[k], cuts[k + 1])) for k in range(segments)]
    signed = lambda x: x - (1 << BITS) if x >> (BITS - 1) else x
    masks = [[signed(sum(own[(i + j) % segments] for j in range(n))) for n in range(1, segments + 1)] for i in range(segments)]
    return masks, [n * distance // segments for n in range(1, segments + 1)]


def chains_hold(a: Column, b: Column, segments: int, distance: int, start: Column | None = None) -> Column:
    """True if from some segment (or from this one) every chain of fingerprints a and b keeps its budget; the whole ring is the last chain."""
    masks, budget = ring(segments, distance)
    differ, any_start = a.bitwiseXOR(b), F.lit(False)
    for i in range(segments):
        held = F.lit(True) if start is None else start == i
        for n in range(segments):
            held = held & (F.bit_count(differ.bitwiseAND(F.lit(masks[i][n]))) <= budget[n])
        any_start = any_start | held
    return any_start


def near_links(fps: DataFrame, distance: int = 2, segments: int = 5, dense: int = DENSE) -> DataFrame:
    """Links (a, b) that connect all fingerprints of fps (distinct, fp) within distance of each other."""
    masks, budget = ring(segments, distance)
    free = budget.count(0)
    if not free:
        raise ValueError("a ring needs more segments than the distance")
    starts = F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(masks[i][free - 1])).alias("key")) for i in range(segments)])
    keyed = fps.select("fp", F.inline(starts))
    shared = written(keyed.groupBy("i", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "ring-keys")
    rows = written(keyed.join(shared, ["i", "key"]), "ring-buckets")
    hot = F.col("n") > dense if distance == 2 else F.lit(False)

    cold = rows.where(~hot)
    pairs = cold.select("i", "key", F.col("fp").alias("a")).join(cold.select("i", "key", F.col("fp").alias("b")), ["i", "key"]).where(F.col("a") < F.col("b")).where(chains_hold(F.col("a"), F.col("b"), segments, distance, F.col("i"))).select("a", "b").distinct()
    if distance != 2:
        return pairs
    points = F.filter(
        F.transform(F.sequence(F.lit(-1), F.lit(BITS - 1)), lambda k: F.when(k < 0, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.greatest(k, F.lit(0))))),
        lambda bit: bit.bitwiseAND(F.element_at(F.array(*[F.lit(masks[i][free - 1]) for i in range(segments)]), F.col("i") + 1)) == 0,
    )
    near = rows.where(hot).select("fp", "i", F.explode(F.transform(points, lambda bit: F.col("fp").bitwiseXOR(bit))).alias("point"))
    balls = near.groupBy("i", "point").agg(F.collect_set("fp").alias("own")).where(F.size("own") > 1)
    stars = balls.select(F.explode("own").alias("a"), F.array_min("own").alias("b")).where(F.col("a") != F.col("b")).distinct()
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2, segments: int = 5, dense: int = DENSE) -> DataFrame:
    """doc_id, fp and component_id for each row of docs."""
    prints = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    own = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(near_links(own.select("fp"), distance, segments, dense), "fingerprint-links")
    rooted = own.join(roots, own["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "component-names")
    of_fp = written(rooted.join(named, "root").select("fp", "component_id"), "fingerprint-components")
    return prints.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def op7_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
