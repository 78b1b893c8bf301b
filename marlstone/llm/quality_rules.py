"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a native column expression over the whole text, and every rule
a row of RULES; measure() and verdict() compile them without user functions, so
the whole operator is one projection above the scan and never shuffles.

Defined results: a null or white-space-only text has no words, all counts zero,
and fails; texts of any length are measured whole. Rows are judged one by one, so
ties, repeated rows and ids that are null keep their own rows; an empty table
gives no rows; columns of the input other than id and text, whatever their names,
are not read by quality_report() and pass untouched through quality_filter().
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import let, load, words

SYMBOLS = "[#*$%&|<>]"
#: Words that hold sentences together in the four languages of the corpus.
STOP_WORDS = (
    "the of and to a in is it that for on with as was are by be this from not "
    "le la les de des du un une et en que qui est dans pour "
    "der die das und mit von den ist nicht sich ein eine zu "
    "el los las y para con se por del una"
).split()
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A document with at least min_words words passes if low <= measure <= high."""

    name: str
    measure: str
    low: float = float("-inf")
    high: float = float("inf")
    min_words: int = 0


#: The threshold table. Ratios are of exact integer counts.
RULES = (
    Rule("enough_words", "n_words", low=10),
    Rule("few_repeats", "repeat_percent", high=20.0),
    Rule("word_length", "mean_word_chars", low=2.0, high=12.0),
    Rule("few_symbols", "symbols_per_word", high=0.5),
    Rule("few_capitals", "capitals_per_char", high=0.4, min_words=20),
    Rule("stop_words", "stop_words_per_word", low=0.03, min_words=30),
    Rule("few_repeated_lines", "dup_lines_per_line", high=0.5),
)
#: The rules that base_failed stands for.
BASE = ("enough_words", "few_repeats")


def _repeat_words(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more.

    Texts without a repeated window, nearly all, cost a hash set of longs. For
    the others the windows are sorted as (hash, place); repeated ones stand
    next to each other, and the words that they cover follow from the gaps
    between their places. No step is quadratic in the text's length.
    """

    def covered(w: Column) -> Column:
        placed = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            last = F.size(s) - 1
            return F.array_sort(
                F.transform(
                    F.filter(
                        F.transform(
                            s,
                            lambda x, k: F.struct(
                                x["i"].alias("i"),
                                (
                                    ((k > 0) & (x["h"] == s[F.greatest(k - 1, F.lit(0))]["h"]))
                                    | ((k < last) & (x["h"] == s[F.least(k + 1, last)]["h"]))
                                ).alias("twice"),
                            ),
                        ),
                        lambda x: x["twice"],
                    ),
                    lambda x: x["i"],
                )
            )

        return let(
            let(placed, places),
            lambda p: F.aggregate(
                F.transform(
                    p, lambda at, k: F.when(k == F.size(p) - 1, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), p[F.least(k + 1, F.size(p) - 1)] - at))
                ),
                F.lit(0).cast("bigint"),
                lambda total, x: total + x,
            ),
        )

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(covered(hashes))


def measure(text: Column) -> Column:
    """One struct of exact counts of a text, in one expression."""
    whole = F.coalesce(text, F.lit(""))

    def of_words(w: Column) -> Column:
        n = F.size(w)
        windows = F.when(n < WINDOW, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), lambda i: F.xxhash64(*[w[i + k] for k in range(WINDOW)]))
        )
        lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            n.cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            F.regexp_count(whole, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
            let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup"), F.size(x).cast("bigint").alias("all"))).alias("lines"),
            let(windows, _repeat_words).alias("n_repeat_words"),
            F.regexp_count(whole, F.lit("[A-Z]")).cast("bigint").alias("n_capitals"),
            F.size(F.filter(w, lambda x: F.lower(F.rtrim(x, F.lit(".,!?;:"))).isin(*STOP_WORDS))).cast("bigint").alias("n_stop_words"),
        )

    return let(words(text), of_words)


def verdict(m: Column, rules: tuple[Rule, ...]) -> Column:
    """True if m, a measure() struct, passes all the rules."""
    n = m["n_words"]
    at = {
        "n_words": n.cast("double"),
        "repeat_percent": 100 * m["n_repeat_words"] / n,
        "mean_word_chars": m["word_chars"] / n,
        "symbols_per_word": m["n_symbols"] / n,
        "capitals_per_char": m["n_capitals"] / m["word_chars"],
        "stop_words_per_word": m["n_stop_words"] / n,
        "dup_lines_per_line": m["lines"]["dup"] / m["lines"]["all"],
    }
    passed = F.lit(True)
    for r in rules:
        x = at[r.measure]
        held = F.lit(True)
        if r.low != float("-inf"):
            held = held & (x >= r.low)
        if r.high != float("inf"):
            held = held & (x <= r.high)
        passed = passed & ((n < r.min_words) | held)
    return (n > 0) & F.coalesce(passed, F.lit(False))


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and verdicts for each row of docs."""
    base = tuple(r for r in rules if r.name in BASE)
    judged = let(measure(F.col(text_col)), lambda m: F.struct(m.alias("m"), verdict(m, base).alias("base"), verdict(m, rules).alias("kept")))
    at = docs.select(F.col(id_col).alias("doc_id"), judged.alias("q"))
    m = "q.m."
    return at.select(
        "doc_id",
        *[F.col(m + c).alias(c) for c in ("n_words", "word_chars", "n_symbols")],
        F.col(m + "lines.dup").alias("n_dup_lines"),
        F.col(m + "n_repeat_words").alias("n_repeat_words"),
        (~F.col("q.base")).alias("base_failed"),
        F.col("q.kept").alias("kept"),
    )


def quality_filter(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that pass, with all their columns."""
    return docs.where(let(measure(F.col(text_col)), lambda m: verdict(m, rules)))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(load(spark, sf_dir, "documents"))


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
OP9_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
win AS (
  SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS gram
  FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(0, 5)) AS k) GROUP BY rid),
m AS (
  SELECT d.rid, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
         coalesce(cov.n, 0) AS n_repeat_words,
         len(regexp_extract_all(text, '[A-Z]')) AS n_capitals,
         len(list_filter(w, lambda x: lower(rtrim(x, '.,!?;:')) IN ({_STOP}))) AS n_stop_words
  FROM d LEFT JOIN cov USING (rid)),
r AS (
  SELECT *, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words >= 2 AND word_chars / n_words <= 12
         AND n_symbols / n_words <= 0.5 AND (n_words < 20 OR n_capitals / word_chars <= 0.4)
         AND (n_words < 30 OR n_stop_words / n_words >= 0.03) AND n_dup_lines / n_lines <= 0.5 AS kept
FROM r
"""
