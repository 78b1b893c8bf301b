"""Pattern matches with code-point offsets, as native columns.

Spark has no function for the offsets of all matches, but the pieces between
them (split) and the matches (regexp_extract_all) come from the same scan, so a
match starts after all pieces up to it and all matches before it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.llm.common import let

SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string,value:string>"
_BLOCK = 128


def _running(a: Column) -> Column:
    """Running sums of a short array."""
    return F.aggregate(a, F.array().cast("array<bigint>"), lambda acc, x: F.array_append(acc, F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + x))


def prefix_sums(a: Column) -> Column:
    """Running sums of an array of bigints, in blocks, as appending to an array copies it."""

    def of(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / _BLOCK).cast("int")), lambda b: _running(F.slice(x, b * _BLOCK + 1, F.lit(_BLOCK))))
        return let(
            blocks,
            lambda own: let(
                _running(F.transform(own, lambda b: F.get(b, F.size(b) - 1))),
                lambda before: F.flatten(F.transform(own, lambda b, k: F.transform(b, lambda v: v + F.when(k == 0, F.lit(0).cast("bigint")).otherwise(F.get(before, k - 1))))),
            ),
        )

    return F.when(F.size(a) == 0, F.array().cast("array<bigint>")).otherwise(let(a, of))


def matches(text: Column, pattern: str, kind: str, rank: int, only_if: Column | None = None) -> Column:
    """Spans of all leftmost non-overlapping matches; rank orders kinds. only_if: a cheap test that any match needs."""

    def of(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        lengths = let(gaps, lambda g: F.transform(found, lambda m, k: (F.length(g[k]) + F.when(k == 0, F.lit(0)).otherwise(F.length(found[F.greatest(k - 1, F.lit(0))]))).cast("bigint")))
        return let(
            prefix_sums(lengths),
            lambda at: F.transform(found, lambda m, k: F.struct(at[k].alias("start"), F.lit(rank).alias("rank"), (at[k] + F.length(m)).alias("end"), F.lit(kind).alias("kind"), m.alias("value"))),
        )

    none = F.array().cast(f"array<{SPAN}>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    spans = let(found, lambda x: F.when(F.size(x) == 0, none).otherwise(of(x)))
    return spans if only_if is None else F.when(only_if, spans).otherwise(none)


def said(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined; spans must be sorted."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others."""
    return F.filter(spans, lambda s: ~F.exists(others, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])))


def leftmost(spans: Column) -> Column:
    """Of sorted spans, those that do not overlap one kept before."""
    start = F.struct(F.lit(-1).cast("bigint").alias("upto"), F.array().cast(f"array<{SPAN}>").alias("kept"))
    return F.aggregate(
        spans,
        start,
        lambda acc, s: F.when(s["start"] >= acc["upto"], F.struct(s["end"].alias("upto"), F.array_append(acc["kept"], s).alias("kept"))).otherwise(acc),
        lambda acc: acc["kept"],
    )
