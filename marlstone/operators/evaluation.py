"""Evaluation of question sets, centred on abstention."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.operators.retrieval import LIMIT, THRESHOLD, passes_threshold
from marlstone.operators.tables import written

KINDS = ("ANSWERABLE", "UNANSWERABLE", "FORBIDDEN")


@dataclass(frozen=True)
class Thresholds:
    recall: float = 0.8
    abstention: float = 0.9
    hallucination: float = 0.1
    over_abstention: float = 0.25
    grounding_failures: float = 0.05
    wrong_answers: float = 0.0
    follow_up: float = 0.8


def ratio(a: Column, b: Column) -> Column:
    """One if there is nothing to divide by."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(1.0))


def share(a: Column, b: Column) -> Column:
    """Zero if there is nothing to divide by."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def percentile(name: str, p: float) -> Column:
    """Nearest rank; zero of nothing."""
    return F.coalesce(F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {name})").cast("double"), F.lit(0.0))


def contains_any(text: Column, terms: Column) -> Column:
    return F.exists(terms, lambda t: F.contains(tx.normalized(text), tx.normalized(t)))


def source_found(hits: Column, terms: Column) -> Column:
    """True if any expected term is in the hits' texts, joined by newlines."""
    return contains_any(F.array_join(hits, "\n"), terms)


def _size(c: str) -> Column:
    return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))


def _judged(cases: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Outcomes with what their cases expect, and conditions over them."""
    own = cases.select(F.col("id").alias("case_id"), "expected_sources", "expected_contains", "must_not_contain", "expects_rewrite")
    kind = {k: F.col("kind") == k for k in KINDS}
    checked = kind["ANSWERABLE"] & (_size("expected_contains") > 0) & F.col("answered")
    follow = F.col("expects_rewrite").isNotNull() & F.col("rewritten").isNotNull()
    return outcomes.join(own, "case_id", "left"), kind | {
        "listed": kind["ANSWERABLE"] & (_size("expected_sources") > 0),
        "signalled": kind["ANSWERABLE"] & (_size("expected_sources") == 0) & F.col("source_found").isNotNull(),
        "checked": checked,
        "wrong": checked & ~F.coalesce(contains_any(F.coalesce("response", F.lit("")), F.col("expected_contains")), F.lit(False)),
        "said": F.coalesce(F.exists("must_not_contain", lambda t: F.contains(F.lower(F.coalesce("response", F.lit(""))), F.lower(t))), F.lit(False)),
        "follow": follow,
        "misread": follow & (F.col("rewritten") != F.col("expects_rewrite")),
    }


def findings(cases: DataFrame, outcomes: DataFrame) -> DataFrame:
    """case_id, finding (wrong_answer, follow_up, forbidden) of each case that a metric counts against: a table, however many there are."""
    at, c = _judged(cases, outcomes)
    named = {"wrong_answer": c["wrong"], "follow_up": c["misread"], "forbidden": (c["FORBIDDEN"] & F.col("answered")) | c["said"]}
    found = F.filter(F.array(*[F.when(F.coalesce(x, F.lit(False)), F.lit(k)) for k, x in named.items()]), lambda x: x.isNotNull())
    return at.select("case_id", F.explode(found).alias("finding"))


def metrics(cases: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row of metrics, all of them numbers; findings() names the cases.

    cases: id, expected_sources, expected_contains, must_not_contain,
    expects_rewrite. outcomes: case_id, kind, answered, retrieved, response,
    latency_ms, cost, grounding_failures, source_found, rewritten.
    """
    at, c = _judged(cases, outcomes)
    size, kind, listed, signalled, checked, wrong, said, follow = _size, c, *(c[k] for k in ("listed", "signalled", "checked", "wrong", "said", "follow"))
    found = F.size(F.filter("expected_sources", lambda s: F.array_contains("retrieved", s)))
    n = lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    sums = at.agg(
        F.count(F.lit(1)).alias("total"),
        *[n(kind[k]).alias(k.lower()) for k in KINDS],
        (n(listed & (found > 0)) + n(signalled & F.col("source_found"))).alias("recall_hits"),
        (n(listed) + n(signalled)).alias("recall_cases"),
        F.coalesce(F.sum(F.when(listed, found)), F.lit(0)).alias("found"),
        F.coalesce(F.sum(F.when(listed, size("retrieved"))), F.lit(0)).alias("retrieved_n"),
        n(listed).alias("precision_cases"),
        n(checked).alias("checked"),
        n(wrong).alias("wrong_n"),
        n(kind["UNANSWERABLE"] & ~F.col("answered")).alias("abstained"),
        n(kind["UNANSWERABLE"] & F.col("answered")).alias("hallucinated"),
        n(kind["ANSWERABLE"] & ~F.col("answered")).alias("silent"),
        (n(kind["FORBIDDEN"] & F.col("answered")) + n(said)).alias("forbidden_violations"),
        n(size("grounding_failures") > 0).alias("ungrounded"),
        n(follow).alias("follow_up_cases"),
        n(c["misread"]).alias("follow_up_failures"),
        percentile("latency_ms", 50).alias("latency_p50"),
        percentile("latency_ms", 95).alias("latency_p95"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_cost"),
    )
    return sums.select(
        "total", *[k.lower() for k in KINDS],
        ratio(F.col("recall_hits"), F.col("recall_cases")).alias("recall_at_k"), "recall_cases",
        ratio(F.col("found"), F.col("retrieved_n")).alias("precision"), "precision_cases",
        share(F.col("wrong_n"), F.col("checked")).alias("wrong_answer_rate"), F.col("wrong_n").alias("wrong_answers"),
        ratio(F.col("abstained"), F.col("unanswerable")).alias("correct_abstention"),
        share(F.col("hallucinated"), F.col("unanswerable")).alias("hallucination_rate"),
        share(F.col("silent"), F.col("answerable")).alias("over_abstention"), "forbidden_violations",
        share(F.col("ungrounded"), F.col("total")).alias("grounding_failure_rate"),
        ratio(F.col("follow_up_cases") - F.col("follow_up_failures"), F.col("follow_up_cases")).alias("follow_up_resolution"), "follow_up_cases", "follow_up_failures",
        "latency_p50", "latency_p95", "total_cost",
    )


def gate(measured: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """passed and failures (names of what is out of bounds). What was not measured is not judged; a forbidden answer always blocks."""
    bad = {
        "recall": (F.col("recall_cases") > 0) & (F.col("recall_at_k") < t.recall),
        "wrong_answers": F.col("wrong_answer_rate") > t.wrong_answers,
        "abstention": F.col("correct_abstention") < t.abstention,
        "hallucination": F.col("hallucination_rate") > t.hallucination,
        "over_abstention": F.col("over_abstention") > t.over_abstention,
        "grounding": F.col("grounding_failure_rate") > t.grounding_failures,
        "follow_up": (F.col("follow_up_cases") > 0) & (F.col("follow_up_resolution") < t.follow_up),
        "forbidden": F.col("forbidden_violations") > 0,
    }
    failures = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in bad.items()]), lambda x: x.isNotNull())
    return measured.select(failures.alias("failures")).select((F.size("failures") == 0).alias("passed"), "failures")


def composition_warnings(cases: DataFrame) -> DataFrame:
    """What makes a set of cases a poor measure, by name."""
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    at = cases.agg(
        F.count(F.lit(1)).alias("n"),
        n(F.col("kind") == "UNANSWERABLE").alias("u"),
        n((F.col("kind") == "ANSWERABLE") & (size("expected_contains") == 0) & (size("expected_sources") == 0)).alias("open"),
        n((size("history") > 0) & F.col("expects_rewrite").isNull()).alias("threaded"),
        n((size("history") == 0) & F.col("expects_rewrite").isNotNull()).alias("threadless"),
    )
    some = F.col("n") > 0
    bad = {
        "empty": ~some,
        "answerable_without_expectation": some & (F.col("open") > 0),
        "thread_without_expectation": some & (F.col("threaded") > 0),
        "expectation_without_thread": some & (F.col("threadless") > 0),
        "no_unanswerable": some & (F.col("u") == 0),
        "few_unanswerable": some & (F.col("u") > 0) & (F.col("u") / F.col("n") < 0.2),
    }
    return at.select(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in bad.items()]), lambda x: x.isNotNull()).alias("warnings"))


@dataclass(frozen=True)
class Run:
    """skipped: case_id, reason. warnings: what makes the run a poor measure."""

    mode: str
    outcomes: DataFrame
    metrics: DataFrame
    gate: DataFrame
    skipped: DataFrame
    warnings: DataFrame


#: id, question, history to id, question, rewritten, cost
Resolve = Callable[[DataFrame], DataFrame]
#: query_id, question to query_id, id, rank, similarity, content
Search = Callable[[DataFrame], DataFrame]
#: query_id, question and hits to query_id, answered, response, cost, grounding_failures
Generate = Callable[[DataFrame, DataFrame], DataFrame]


def run_suite(cases: DataFrame, search: Search, generate: Generate | None = None, resolve: Resolve | None = None, threshold: float = THRESHOLD, limit: int = LIMIT, t: Thresholds = Thresholds()) -> Run:
    """A whole set of cases as one job: resolve, search, gate, generate, measure.

    cases: id, kind, question, history (array of turns) and what metrics() and
    composition_warnings() read. Cases with a history are skipped if there is no
    resolver, as their literal question would measure another system. Without a
    generator the mode is retrieval, where passing the threshold counts as an
    answer, which a warning says. What is not over the threshold is not generated;
    the resolver's cost stands.
    """
    threaded = F.coalesce(F.size("history"), F.lit(0)) > 0
    runs = cases if resolve is not None else cases.where(~threaded)
    skipped = cases.where(threaded if resolve is None else F.lit(False)).select(F.col("id").alias("case_id"), F.lit("no resolver").alias("reason"))
    asked = runs.select("id", "question", "history")
    plain = asked.where(~threaded).select("id", "question", F.lit(None).cast("boolean").alias("rewritten"), F.lit(0.0).alias("cost"))
    if resolve is not None:
        plain = plain.unionByName(resolve(asked.where(threaded)).select("id", "question", "rewritten", F.col("cost").cast("double").alias("cost")))
    asked = written(plain, "suite-questions")
    queries = asked.select(F.col("id").alias("query_id"), "question")
    hits = written(search(queries).where(F.col("rank") <= limit), "suite-hits")
    passed = passes_threshold(queries, hits, threshold)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("id").cast("string").alias("id"), "content"))), lambda x: F.struct(x["id"].alias("id"), x["content"].alias("content")))
    of_query = hits.groupBy("query_id").agg(ordered.alias("hits"))
    none = F.array().cast("array<struct<id:string,content:string>>")
    at = runs.select("id", "kind", "expected_contains").join(asked, "id").join(passed.withColumnRenamed("query_id", "id"), "id").join(of_query.withColumnRenamed("query_id", "id"), "id", "left").withColumn("hits", F.coalesce("hits", none))
    if generate is not None:
        ready = passed.where("passed").select("query_id")
        made = generate(queries.join(ready, "query_id", "left_semi"), hits.join(ready, "query_id", "left_semi")).select(F.col("query_id").alias("id"), "answered", "response", F.col("cost").alias("generate_cost"), "grounding_failures")
        at = at.join(made, "id", "left")
    else:
        at = at.select("*", F.lit(True).alias("answered"), F.lit(None).cast("string").alias("response"), F.lit(0.0).alias("generate_cost"), F.array().cast("array<string>").alias("grounding_failures"))
    contents = F.transform("hits", lambda h: h["content"])
    outcomes = written(
        at.select(
            F.col("id").alias("case_id"), "kind", (F.col("passed") & F.coalesce("answered", F.lit(False))).alias("answered"), F.transform("hits", lambda h: h["id"]).alias("retrieved"), F.when(F.col("passed"), F.col("response")).alias("response"),
            F.lit(0).cast("bigint").alias("latency_ms"), (F.col("cost") + F.when(F.col("passed"), F.coalesce("generate_cost", F.lit(0.0))).otherwise(0.0)).alias("cost"), F.when(F.col("passed"), F.col("grounding_failures")).alias("grounding_failures"),
            F.when(_size("expected_contains") > 0, source_found(contents, F.col("expected_contains"))).alias("source_found"), "rewritten", F.col("question").alias("resolved_question"),
        ),
        "suite-outcomes",
    )
    mode = "retrieval" if generate is None else "full"
    measured = metrics(runs, outcomes)
    said = skipped.agg(F.count(F.lit(1)).alias("n")).select(F.filter(F.array(F.when(F.col("n") > 0, F.lit("threads_skipped")), F.lit("abstention_not_measured" if generate is None else None)), lambda x: x.isNotNull()).alias("w"))
    warnings = composition_warnings(runs).select(F.concat("warnings", said.scalar()).alias("warnings"))
    return Run(mode, outcomes, measured, gate(measured, t), skipped, warnings)


def report(row: dict) -> str:
    """Text of a metrics row."""
    return "\n".join(f"{k:>24}  {v:.4f}" if isinstance(v, float) else f"{k:>24}  {v}" for k, v in row.items())
