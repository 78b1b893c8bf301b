"""Filter interaction audit: what each filter removes, in every order of the filters.

Failure flags are columns of one projection over whole texts. Rows are counted by
part, flags and labels; SQL CUBE over those counts gives, in the grouping sets that
keep the part, the rows in which all flags of a set of filters are false: what
survives that set. A step of an order goes from one set to the set with one filter
more, so all orders follow from the pairs of such sets, 80 for five filters, which
are joined once and dealt to the orders' steps.

Skew: only 40-byte digests are shuffled, never texts; copies are aggregated before
they meet, and the rows of a hot digest, label or part are joined plainly with a
written table, whose hot keys adaptive execution splits, or counted with partial
sums. Beyond the flags all tables have a few rows for each part.

Defined results: a null text counts as empty (under the least words; equal to other
empty ones); texts of any length are measured whole; a null part counts as the empty
string. A row with a null id is never a copy and has no labels; rows that repeat an
id are not copies of each other, and each counts. Of several labels of one document
the largest holds; null labels are none. An empty table gives no rows. Other columns
are not read, so they may have any name.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import let, load, words, written

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT = 50, 65, 5
SYMBOLS = "[#$%&*|]"
CAPITALS = "[A-Z]"
COUNTS = ("n", "good", "toxic")


def text_flags(text: Column) -> Column:
    """Struct of A (few words), B (few distinct ones), C (many capitals) and D (symbols); text is not null."""
    return let(
        words(text),
        lambda w: F.struct(
            (F.size(w) < LEAST_WORDS).alias("A"),
            (100 * F.size(F.array_distinct(w)) < LEAST_DISTINCT_PERCENT * F.size(w)).alias("B"),
            (100 * F.regexp_count(text, F.lit(CAPITALS)) > MOST_CAPITALS_PERCENT * F.length(text)).alias("C"),
            text.rlike(SYMBOLS).alias("D"),
        ),
    )


def flagged(docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, the five flags, good and toxic for each row of docs."""
    whole = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(whole, 256)).alias("digest"), text_flags(whole).alias("own"))
    rows = written(rows.select("id", "part", "digest", "own.*"), "audit-flags")
    first = written(rows.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("digest", "first"), "audit-copies")
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id"))
    marks = written(marks.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")), "audit-labels")
    copied = rows.join(first, "digest", "left").withColumn("E", F.coalesce(F.col("id") > F.col("first"), F.lit(False)))
    marked = copied.join(marks, "id", "left")
    return marked.select("part", *FILTERS, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def survivors(flags: DataFrame) -> DataFrame:
    """part, mask (bit k: filter k is applied) and the rows, good ones and toxic ones that no filter of the mask removes."""
    counts = flags.groupBy("part", *FILTERS).agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    counts = written(counts, "audit-counts")
    cube = counts.cube("part", *FILTERS).agg(*[F.sum(c).alias(c) for c in COUNTS], F.grouping("part").alias("all_parts"), *[F.grouping(f).alias(f"no_{f}") for f in FILTERS])
    applied = [F.col(f"no_{f}") == 0 for f in FILTERS]
    passed = F.col("all_parts") == 0
    for f in FILTERS:
        passed = passed & ((F.col(f"no_{f}") == 1) | ~F.col(f))
    mask = sum((F.when(a, F.lit(1 << k)).otherwise(F.lit(0)) for k, a in enumerate(applied)), F.lit(0))
    kept = cube.where(passed).select("part", mask.cast("int").alias("mask"), *COUNTS)
    # a set that nothing survives has no such row
    every = counts.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))).alias("mask"))
    return written(every.join(kept, ["part", "mask"], "left").select("part", "mask", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in COUNTS]), "audit-survivors")


def audit(flags: DataFrame) -> DataFrame:
    """The full report of rows with flags: a row for each part, order of the filters and step."""
    sets = survivors(flags)
    every, last = len(FILTERS), (1 << len(FILTERS)) - 1
    orders = math.factorial(every)
    rank = F.bit_count("mask").cast("int")
    # each set with each filter that it lacks, and how many orders go through that pair
    through = F.element_at(F.array(*[F.lit(math.factorial(s) * math.factorial(every - 1 - s)) for s in range(every)]), rank + 1)
    lacking = F.filter(F.array(*[F.lit(k) for k in range(every)]), lambda k: F.col("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1), k)) == 0)
    before = sets.where(F.col("mask") < last).select("part", "mask", *[F.col(c).alias(f"{c}_before") for c in COUNTS], through.cast("bigint").alias("orders"), F.explode(lacking).alias("filter"))
    before = before.withColumn("next", F.col("mask").bitwiseOR(F.call_function("shiftleft", F.lit(1), F.col("filter"))))
    after = sets.select("part", F.col("mask").alias("next"), *[F.col(c).alias(f"{c}_after") for c in COUNTS])
    pairs = before.join(after, ["part", "next"]).select(
        "part", "mask", "next", "filter", "orders", F.col("n_after").alias("kept"),
        *[(F.col(f"{c}_before") - F.col(f"{c}_after")).alias(name) for c, name in zip(COUNTS, ("removed", "good_lost", "toxic_lost"))],
    )
    pairs = written(pairs, "audit-pairs")
    # the first and the last pair of a filter: all that fail it, and those that fail nothing else
    of_filter = pairs.groupBy("part", "filter").agg(
        F.max(F.when(F.col("mask") == 0, F.col("removed"))).alias("fails"), F.max(F.when(F.col("next") == last, F.col("removed"))).alias("unique_fails"), F.sum(F.col("removed") * F.col("orders")).alias("shapley")
    )
    spark = flags.sparkSession
    steps = []
    for p in permutations(range(every)):
        mask = 0
        for step, k in enumerate(p, 1):
            steps.append(("".join(FILTERS[x] for x in p), step, mask, k))
            mask |= 1 << k
    assert len(steps) == orders * every
    steps = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, mask int, filter int"))  # 600 rows, fixed
    found = pairs.join(of_filter, ["part", "filter"]).join(steps, ["mask", "filter"])
    return found.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(flagged(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")))


OP11_SQL = r"""
WITH marks AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * len(regexp_extract_all(d.text, '[A-Z]')) > 5 * length(d.text),
          regexp_matches(d.text, '[#$%&*|]'), coalesce(d.doc_id > first, false)] AS fails
  FROM d JOIN firsts ON d.text = firsts.text LEFT JOIN marks USING (doc_id)),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
met AS (
  SELECT part, filter_order, step, n, good, toxic, fails,
         fails[ascii(substr(filter_order, step, 1)) - 64] AS own,
         len(list_filter(range(1, step), lambda k: fails[ascii(substr(filter_order, k, 1)) - 64])) > 0 AS earlier,
         len(list_filter(fails, lambda x: x)) AS n_fails
  FROM c, steps),
r AS (
  SELECT part, filter_order, step,
         coalesce(sum(n) FILTER (NOT own AND NOT earlier), 0) AS kept, coalesce(sum(n) FILTER (own AND NOT earlier), 0) AS removed,
         coalesce(sum(n) FILTER (own AND earlier), 0) AS redundant, coalesce(sum(n) FILTER (own AND n_fails = 1), 0) AS unique_fails,
         coalesce(sum(good) FILTER (own AND NOT earlier), 0) AS good_lost, coalesce(sum(toxic) FILTER (own AND NOT earlier), 0) AS toxic_lost
  FROM met GROUP BY part, filter_order, step)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)))::BIGINT AS shapley
FROM r
"""
