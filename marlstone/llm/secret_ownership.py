"""Secrets, judged by who owns them across the corpus.

Base patterns (assign, access, hex) are exact and always stay. Generators
propose further credential shapes, of any length. Every candidate's value is
hashed in its row, and only the hash leaves it; the corpus is aggregated to the
distinct repositories and owners of each hash. A value that few owners have, in
few repositories, and that looks random is live; one that many owners share, or
that one owner copied through many repositories, is an example. Generated spans
are kept only if they are live; base spans carry the verdict in the counts.

Skew: a value that a third of the corpus copies is aggregated to (hash, owner)
and (hash, repository) before it is counted, with partial sums on the map side;
verdicts return over a plain join with a written table, whose hot keys adaptive
execution splits.

Defined results: null and empty texts have no spans; texts of any length are read
whole; a null owner or repository is one owner or repository by itself; repeated
rows each keep a row and count as one repository; an empty table gives no rows.
Only the four named columns are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import let, load, written
from marlstone.llm.spans import apart, leftmost, matches, said

KINDS = ("assign", "access", "hex", "github", "slack", "google", "jwt", "bearer", "sk", "pem")
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: kind: (pattern, a cheap test that any match needs)
BASE = {
    "assign": (ASSIGN, r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"),
    "access": (r"AKIA[A-Z0-9]{12,}+", "AKIA"),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{32,}+", r"[0-9a-f]{32}"),
}
GENERATORS = {
    "github": (r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{36,}+|github_pat_[A-Za-z0-9_]{22,}+)", r"gh[pousr]_|github_pat_"),
    "slack": (r"(?<![A-Za-z0-9])xox[abeoprs]-[A-Za-z0-9-]{10,}+", "xox"),
    "google": (r"(?<![A-Za-z0-9_-])AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])", "AIza"),
    "jwt": (r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+", "eyJ"),
    "bearer": (r"(?i:bearer)\x20++[A-Za-z0-9._~+/-]{20,}+=*+", r"(?i:bearer)\x20"),
    "sk": (r"(?<![A-Za-z0-9_-])[prs]k[-_](?:live[-_]|test[-_]|proj[-_])?[A-Za-z0-9]{20,}+", r"[prs]k[-_]"),
    "pem": (r"-----BEGIN\x20(?:[A-Z]++\x20)*?PRIVATE\x20KEY-----\s*+(?:[A-Za-z0-9+/]{16,}+={0,2}+\s*+)++(?:[A-Za-z0-9+/]++={0,2}+(?=\s*+-----END))?+", "PRIVATE"),
}
#: A live value has at most so many owners and repositories and at least so many different characters.
MOST_OWNERS = 3
MOST_REPOSITORIES = 20
LEAST_VARIED = 8


def credential(span: Column) -> Column:
    """The part of a span that is the secret itself."""
    v = span["value"]
    return F.when(span["kind"] == "assign", F.regexp_extract(v, ASSIGN, 1)).when(span["kind"] == "bearer", F.regexp_extract(v, r"(?i:bearer)\x20+(.*)", 1)).otherwise(v)


def base_spans(text: Column) -> Column:
    """Sorted spans of the base patterns that pass their tests."""
    found = {k: matches(text, p, k, KINDS.index(k), text.rlike(test)) for k, (p, test) in BASE.items()}
    found["assign"] = F.filter(found["assign"], lambda s: F.length(credential(s)) >= 8)
    return F.array_sort(F.concat(*found.values()))


def candidates(text: Column) -> Column:
    """Struct of base spans and of the generators' spans apart from them, with hashes in place of their values."""
    more = [matches(text, p, k, KINDS.index(k), text.rlike(test)) for k, (p, test) in GENERATORS.items()]

    def hashed(s: Column) -> Column:
        secret = credential(s)
        return F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), F.sha2(secret, 256).alias("hash"), F.size(F.array_distinct(F.split(secret, ""))).alias("varied"))

    return let(base_spans(text), lambda b: F.struct(F.transform(b, hashed).alias("base"), F.transform(leftmost(F.array_sort(apart(F.concat(*more), b))), hashed).alias("more")))


def secret_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str = "doc_id", most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES
) -> DataFrame:
    """doc_id, base, spans (arrays of spans, sorted) and judged of each row.

    judged: start, rank, n_owners, n_repositories, live of every candidate, sorted.
    """
    columns = [F.col(id_col).alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), F.col(repository_col).cast("string").alias("repository")]
    found = docs.select(*columns, candidates(F.coalesce(F.col(text_col), F.lit(""))).alias("c")).select("*", "c.base", "c.more").drop("c")
    rows = written(found.withColumn("row", F.monotonically_increasing_id()), "secret-candidates")

    at = rows.where((F.size("base") > 0) | (F.size("more") > 0)).select("row", "owner", "repository", F.explode(F.concat("base", "more")).alias("span"))
    hashes = at.select(F.col("span.hash").alias("hash"), "owner", "repository")
    owners = hashes.select("hash", "owner").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"))
    repositories = hashes.select("hash", "repository").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n_repositories"))
    owned = written(owners.join(repositories, "hash"), "secret-owners")
    live = (F.col("n_owners") <= most_owners) & (F.col("n_repositories") <= most_repositories) & (F.col("span.varied") >= LEAST_VARIED)
    each = at.withColumn("hash", F.col("span.hash")).join(owned, "hash").select("row", F.struct("span.start", "span.rank", "n_owners", "n_repositories", live.alias("live")).alias("j"))
    judged = each.groupBy("row").agg(F.array_sort(F.collect_list("j")).alias("judged"))
    none = F.array().cast("array<struct<start:bigint,rank:int,n_owners:bigint,n_repositories:bigint,live:boolean>>")
    both = rows.join(judged, "row", "left").withColumn("judged", F.coalesce("judged", none))
    lives = F.transform(F.filter("judged", lambda j: j["live"]), lambda j: F.struct(j["start"], j["rank"]))
    kept = let(lives, lambda own: F.filter("more", lambda s: F.array_contains(own, F.struct(s["start"], s["rank"]))))
    return both.select("doc_id", "base", F.array_sort(F.concat("base", kept)).alias("spans"), "judged")


def op6_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_live and n_example: candidates by verdict; most_owners and most_repositories: of any candidate of the document."""
    found = secret_spans(load(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    live = F.size(F.filter("judged", lambda j: j["live"])).cast("bigint")
    most = lambda c: F.coalesce(F.array_max(F.transform("judged", lambda j: j[c])), F.lit(0).cast("bigint"))
    return found.select(
        "doc_id", *[count(k) for k in BASE], F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), live.alias("n_live"), (F.size("judged") - live).alias("n_example"),
        most("n_owners").alias("most_owners"), most("n_repositories").alias("most_repositories"),
    )
