"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over consecutive tokens that ignores some positions, so a
substituted token breaks only the seeds that read it. Seeds of the benchmark are
indexed by hash; a document's seeds are tested in place against a bit table of
the pairs of tokens that seeds begin with, then against one of the hashes, and
only documents with a seed that passes go on, with their tokens.

A seed that a document and an item share puts them on one diagonal. The whole
diagonal is then compared token by token, however long both are: an overlap is a
place where LEAST_MATCHED equal tokens stand within LEAST_MATCHED / LEAST_SHARE
consecutive ones, and all overlaps of the diagonal are reported together. An item
of fewer tokens than that convicts if it stands whole and unchanged; items
shorter than the masks have a seed of their own, over all their tokens.

The benchmark is the query set: it is taken in blocks of at most BLOCK_SEEDS
seeds, each with bit tables and broadcasts of bounded size, so documents are
never shuffled but for those with a hit. Everything is native columns.

Defined results: tokens are runs of letters and digits, lowered; null texts have
none. Items of fewer than LEAST_ITEM tokens say too little to convict anyone and
take no part. Repeated rows give the same (doc_id, item_id) once, with the hits
of all of them. An empty table on either side gives no rows; other columns of
the inputs are not read, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.bit_table import BitTable
from marlstone.llm.common import few, let, load, written

#: Both masks span ten tokens and read seven or eight of them.
MASKS = ("1101101111", "1111011011")
SPAN = len(MASKS[0])
#: Shorter items have a mask of their own length, all of it read.
LEAST_ITEM = 5
SHORT = range(LEAST_ITEM, SPAN)
ALL_MASKS = (*MASKS, *("1" * n for n in SHORT))
assert all(m.startswith("11") for m in ALL_MASKS)
LEAST_MATCHED = 12
#: Numerator and denominator of the least share of equal tokens in an overlap.
LEAST_SHARE = (4, 5)
BLOCK_SEEDS = 2_000_000


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _places(own: Column, span: int) -> Column:
    return F.when(F.size(own) < span, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(F.size(own) - span, F.lit(0))))


def _pair(own: Column, i: Column) -> Column:
    """Hash of the two tokens that every mask reads first."""
    return F.xxhash64(own[i], own[i + 1])


def _seed(own: Column, i: Column, mask: int) -> Column:
    return F.xxhash64(F.lit(mask), *[F.get(own, i + k) for k, c in enumerate(ALL_MASKS[mask]) if c == "1"])


def _seeds_at(own: Column, places: Column, mask: int) -> Column:
    """Array of struct(place, mask, hash): one mask at those of the places where it fits."""
    fits = F.filter(places, lambda i: i + len(ALL_MASKS[mask]) <= F.size(own))
    return F.transform(fits, lambda i: F.struct(i.alias("place"), F.lit(mask).alias("mask"), _seed(own, i, mask).alias("hash")))


def item_seeds(own: Column) -> Column:
    """Seeds of a benchmark item: both masks everywhere, or one over all of a short item."""
    spaced = F.concat(*[_seeds_at(own, _places(own, SPAN), m) for m in range(len(MASKS))])
    out = spaced
    for k, n in enumerate(SHORT):
        out = F.when(F.size(own) == n, _seeds_at(own, F.array(F.lit(0)), len(MASKS) + k)).otherwise(out)
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> list[DataFrame]:
    """(item_id, item) in blocks whose seeds are counted."""
    items = benchmark.select(F.col(item_col).alias("item_id"), tokens(F.col(text_col)).alias("item")).where(F.size("item") >= LEAST_ITEM)
    n = items.agg(F.sum(F.size("item") * len(MASKS))).first()[0] or 0
    parts = -(-n // BLOCK_SEEDS) or 1
    return [items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(parts)) == k) for k in range(parts)]


def _overlaps(doc: Column, item: Column, diagonal: Column) -> Column:
    """struct(matched, overlap) of a whole diagonal: tokens in its overlaps, equal ones and all; zeros if it has none.

    diagonal: place in doc less place in item.
    """
    first, last = F.greatest(F.lit(0), -diagonal), F.least(F.size(item), F.size(doc) - diagonal) - 1
    equal = F.when(first <= last, F.filter(F.sequence(first, F.greatest(first, last)), lambda j: F.get(doc, j + diagonal) == F.get(item, j))).otherwise(F.array().cast("array<int>"))
    least = F.least(F.lit(LEAST_MATCHED), F.size(item))
    up, down = LEAST_SHARE

    def of(p: Column) -> Column:
        runs = F.when(F.size(p) < least, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(0), F.greatest(F.size(p) - least, F.lit(0))), lambda i: down * least >= up * (F.get(p, i + least - 1) - F.get(p, i) + 1)))

        def covered(starts: Column) -> Column:
            # what each run adds to those before it
            def adds(i: Column, k: Column) -> Column:
                before = F.when(k == 0, F.lit(-1)).otherwise(F.get(starts, F.greatest(k - 1, F.lit(0))) + least - 1)
                n = F.least(least, i + least - 1 - before)
                return F.struct(n.alias("n"), (F.get(p, i + least - 1) - F.when(i <= before, F.get(p, F.greatest(before, F.lit(0)))).otherwise(F.get(p, i) - 1)).alias("w"))

            zero = F.struct(F.lit(0).alias("matched"), F.lit(0).alias("overlap"))
            return F.aggregate(F.transform(starts, adds), zero, lambda acc, x: F.struct((acc["matched"] + x["n"]).alias("matched"), (acc["overlap"] + x["w"]).alias("overlap")))

        return let(runs, covered)

    return let(equal, of)


def _hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Overlaps of docs (doc_id, text) with one block of items."""
    index = written(items.select("item_id", F.inline(let(F.col("item"), item_seeds))).withColumnRenamed("place", "item_at"), "benchmark-seeds")
    spans = sorted({m for (m,) in index.select("mask").distinct().collect()})  # at most as many as there are masks
    heads = items.select(F.explode(let(F.col("item"), lambda w: F.transform(F.when(F.size(w) < SPAN, F.array(F.lit(0))).otherwise(_places(w, SPAN)), lambda i: _pair(w, i)))).alias("hash"))
    pairs, hashes = BitTable(heads, "benchmark-pairs"), BitTable(index.select("hash"), "benchmark-seeds")

    def passing(w: Column) -> Column:
        # nearly all places fail on their first two tokens
        likely = F.filter(_places(w, LEAST_ITEM), lambda i: pairs.holds(F.col("pairs"), _pair(w, i)))
        found = lambda p: F.filter(F.concat(*[_seeds_at(w, p, m) for m in spans]), lambda x: hashes.holds(F.col("hashes"), x["hash"]))
        return F.struct(w.alias("doc"), let(likely, found).alias("seeds"))

    if not spans:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, matched int, overlap int, n_seeds bigint")
    at = docs.select("doc_id", "text", pairs.table.scalar().alias("pairs"), hashes.table.scalar().alias("hashes"))
    # numbering the rows keeps the filter above the projection, where seeds are found once
    found = at.select("doc_id", F.monotonically_increasing_id().alias("row"), let(tokens(F.col("text")), passing).alias("c")).where(F.size("c.seeds") > 0)
    held = written(found.select("doc_id", "row", "c.doc", "c.seeds"), "documents-with-seeds")
    hits = held.select("row", F.inline("seeds")).join(index, ["mask", "hash"])
    met = hits.groupBy("row", "item_id", (F.col("place") - F.col("item_at")).alias("diagonal")).agg(F.count(F.lit(1)).alias("n_seeds"))
    aligned = met.join(held.select("row", "doc_id", "doc"), "row").join(F.broadcast(items.withColumnRenamed("item_id", "own")), F.col("item_id").eqNullSafe(F.col("own")))
    judged = aligned.select("doc_id", "item_id", "n_seeds", _overlaps(F.col("doc"), F.col("item"), F.col("diagonal")).alias("o"), F.monotonically_increasing_id().alias("hit"))
    return judged.select("doc_id", "item_id", "o.matched", "o.overlap", "n_seeds").where("matched > 0")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, matched_words, overlap_words, n_hits) of documents that hold a good part of a benchmark item.

    The words are those of the diagonal with most equal ones; hits are the seeds of all diagonals that convict.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    hits = reduce(DataFrame.unionByName, [_hits(own, items) for items in _blocks(benchmark, item_col, item_text_col)])
    best = hits.groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", F.negative("overlap").alias("less"))).alias("b"), F.sum("n_seeds").alias("n_hits"))
    return best.select("doc_id", "item_id", F.col("b.matched").cast("bigint").alias("matched_words"), F.negative("b.less").cast("bigint").alias("overlap_words"), "n_hits")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is not contaminated, with all their columns."""
    bad = few(written(contaminated(docs, benchmark, id_col, text_col).select("doc_id").distinct(), "contaminated"))
    return docs.alias("own").join(bad.alias("bad"), F.col(f"own.`{id_col}`").eqNullSafe(F.col("bad.doc_id")), "left_anti")


def op4_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def _sql_mask(m: int, of: str) -> str:
    return " || ' ' || ".join(f"{of}[i + {k}]" for k, c in enumerate(ALL_MASKS[m]) if c == "1")


def _sql_seeds(source: str, keys: str, w: str, short: bool) -> str:
    """Seeds of every mask; of a benchmark item a short mask only where it covers the item."""
    at = lambda m: f"SELECT {keys}, i, {m} AS mask, {_sql_mask(m, w)} AS seed FROM {source} WHERE i + {len(ALL_MASKS[m]) - 1} <= len({w})"
    return " UNION ALL ".join(at(m) + (f" AND len({w}) = {len(ALL_MASKS[m])}" if short and m >= len(MASKS) else "") for m in range(len(ALL_MASKS)))


OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS bid, item_id, t FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS t FROM benchmark) WHERE len(t) >= {LEAST_ITEM}),
dp AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d),
bp AS (SELECT bid, t, unnest(range(1, len(t) + 1)) AS i FROM b),
ds AS ({_sql_seeds("dp", "rid", "w", False)}),
bs AS ({_sql_seeds("bp", "bid", "t", True)}),
h AS (SELECT ds.rid, bs.bid, ds.i - bs.i AS diagonal, count(*) AS n_seeds FROM ds JOIN bs USING (mask, seed) GROUP BY ALL),
a AS (SELECT row_number() OVER () AS hit, doc_id, item_id, diagonal, n_seeds, w, t, least({LEAST_MATCHED}, len(t)) AS least FROM h JOIN d USING (rid) JOIN b USING (bid)),
k AS (SELECT hit, doc_id, item_id, n_seeds, least, diagonal, w, t, unnest(range(greatest(1, 1 - diagonal), least(len(t), len(w) - diagonal) + 1)) AS j FROM a),
e AS (SELECT hit, doc_id, item_id, n_seeds, least, j, row_number() OVER (PARTITION BY hit ORDER BY j) AS r FROM k WHERE w[j + diagonal] = t[j]),
s AS (SELECT x.hit, x.r, x.j AS low, y.j AS high, x.least FROM e x JOIN e y ON x.hit = y.hit AND y.r = x.r + x.least - 1 WHERE {LEAST_SHARE[1]} * x.least >= {LEAST_SHARE[0]} * (y.j - x.j + 1)),
c AS (SELECT DISTINCT s.hit, unnest(range(low, high + 1)) AS j FROM s),
o AS (SELECT c.hit, count(*) AS overlap, count(e.j) AS matched FROM c LEFT JOIN e ON c.hit = e.hit AND c.j = e.j GROUP BY c.hit),
g AS (SELECT doc_id, item_id, n_seeds, matched, overlap FROM o JOIN a USING (hit))
SELECT doc_id, item_id, matched::BIGINT AS matched_words, overlap::BIGINT AS overlap_words, (sum(n_seeds) OVER (PARTITION BY doc_id, item_id))::BIGINT AS n_hits
FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, overlap) = 1
"""
