"""A table of stored queries against documents: which queries does each document match?

Queries of the web-search language are parsed in tasks and indexed by an anchor: of
each alternative the word that the fewest documents have. Documents meet only the
alternatives whose anchor they hold, and what is left of a candidate (its other words,
phrases, exclusions) is verified on the positions of its words, as joins; no texts
move and documents times queries never become rows. Alternatives of exclusions alone
have no anchor; what they exclude is found in the same way and taken from all.

Skew: a hot word is no anchor unless a query has nothing rarer, and then its documents
are the query's own candidates; candidates meet postings in plain joins with written
tables, whose hot keys adaptive execution splits.

Defined results: words are those of the analyser; a query without words, or a null
one, matches nothing. Rows that repeat an id are one document and rows that repeat a
query id one query with all their alternatives. Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.lexical import Analyser, identity_analyser, parse_query
from marlstone.operators.tables import written


def parsed(queries: DataFrame) -> DataFrame:
    """query_id, row (a number of the query's text), alternative, part, negated, words of queries (query_id, query)."""
    kind = pa.list_(pa.struct([("alternative", pa.int32()), ("part", pa.int32()), ("negated", pa.bool_()), ("words", pa.list_(pa.string()))]))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [[{"alternative": a, "part": p, "negated": t.negated, "words": list(t.words)} for a, own in enumerate(parse_query(q or "")) for p, t in enumerate(own)] for q in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, kind)], ["query_id", "parts"])

    at = queries.select("query_id", "query")
    schema = f"query_id {at.schema['query_id'].dataType.simpleString()}, parts array<struct<alternative:int,part:int,negated:boolean,words:array<string>>>"
    return at.distinct().mapInArrow(parse, schema).withColumn("row", F.monotonically_increasing_id()).select("query_id", "row", F.explode("parts").alias("p")).select("query_id", "row", "p.*")


def percolate(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", analyser: Analyser = identity_analyser) -> DataFrame:
    """query_id, id of the documents that each query (query_id, query) matches."""
    parts = written(parsed(queries), "stored-queries")
    words = parts.select("query_id", "row", "alternative", "part", "negated", F.posexplode("words").alias("place", "term"))
    asked = written(words.select("term").distinct(), "asked-words")
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(analyser(F.coalesce(F.col(text_col), F.lit("")))).alias("position", "term"))
    found = written(rows.join(asked, "term", "left_semi").groupBy("term", "id").agg(F.array_sort(F.collect_list("position")).alias("positions")), "asked-postings")
    held = written(found.groupBy("term").agg(F.count(F.lit(1)).alias("held")), "words-held")

    # the rarest word of each alternative; a word that no document has is rarest of all
    key = ["query_id", "row", "alternative"]
    rarest = words.where(~F.col("negated")).join(held, "term", "left").groupBy(*key).agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("n"), "term")).alias("anchor"))
    anchors = written(rarest.where("anchor.n > 0").select(*key, F.col("anchor.term").alias("term")), "anchors")
    candidates = written(anchors.join(found.select("term", "id"), "term").select(*key, "id"), "candidates")

    matched = candidates.join(_failing(candidates, words, found), [*key, "id"], "left_anti").select("query_id", "id")
    # alternatives of exclusions alone: a stated set, against all documents
    bare = parts.groupBy(*key).agg(F.bool_and("negated").alias("bare")).where("bare").select(*key)
    bare = written(bare, "bare-alternatives")
    if bare.isEmpty():
        return matched.distinct()
    excluded = words.join(bare, key, "left_semi")
    hit = excluded.join(found.select("term", "id"), "term").select(*key, "id").distinct()
    out = written(hit.join(_failing(hit, excluded, found), [*key, "id"], "left_semi"), "excluded")
    names = F.array(*[F.struct(*[F.lit(r[c]).cast(bare.schema[c].dataType).alias(c) for c in key]) for r in bare.collect()])
    every = docs.select(F.col(id_col).alias("id")).distinct().select("id", F.explode(names).alias("a")).select("a.*", "id")
    return matched.unionByName(every.join(out, [*key, "id"], "left_anti").select("query_id", "id")).distinct()


def _failing(candidates: DataFrame, words: DataFrame, found: DataFrame) -> DataFrame:
    """Those of candidates (key, id) that have a part which does not hold: a missing word or phrase, or one that is excluded."""
    key = ["query_id", "row", "alternative"]
    own = candidates.join(words, key).join(found, ["term", "id"], "left")
    # where a phrase starts if a word stands where it does
    starts = F.transform(F.coalesce("positions", F.array().cast("array<int>")), lambda p: p - F.col("place"))
    lists = own.select(*key, "id", "part", "negated", "place", starts.alias("starts")).groupBy(*key, "id", "part", "negated").agg(F.collect_list("starts").alias("of_words"))
    together = F.aggregate(F.slice("of_words", 2, F.greatest(F.size("of_words") - 1, F.lit(0))), F.get("of_words", F.lit(0)), lambda a, b: F.array_intersect(a, b))
    return lists.where((F.size(together) > 0) == F.col("negated")).select(*key, "id").distinct()
