"""Mixing sources to target weights over a domain-language-source tree.

Every leaf can give its tokens max_epochs times. The budget goes down the tree:
siblings share what their parent got by weight, none gets more than its subtree
can give, and what one cannot take goes to its siblings by weight. Only what a
whole subtree cannot take is left for the siblings of the ancestor, because a
node's limit is the sum of its leaves'. With limits known the level at which each
set of siblings fills up has a closed form over running sums, so a level of the
tree is two window functions over a table of tree nodes.

A leaf takes documents in seeded epochs: each epoch orders them by the MD5 of
seed, epoch and id, whole epochs are taken first, and the last one up to the
budget. The cut is found by summing tokens over 256 ranges of the hash, then over
256 parts of the range where the budget ends, and once more; only the documents
of the last part are sorted, so a leaf that holds most of the corpus costs a task
no more rows than others. A cut is one hash, so choosing documents is a filter
that never shuffles texts.

Defined results: null domain, language or source count as ''. A null or empty text
has no tokens; long ones are counted whole. Rows with the same id (or none) share
their place: all are taken or none. Leaves without tokens give every row once. An
empty table gives no rows. Columns pass inside a struct, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import few, load, written

LEVELS = ("domain", "lang", "source")
DOMAINS = ("web", "news", "books", "forum")
#: Weights of nodes by path; paths that are not named weigh one.
WEIGHTS: Mapping[tuple[str, ...], float] = {("web",): 3.0, ("news",): 2.0, **{(d, "en"): 4.0 for d in DOMAINS}, **{(d, x): 2.0 for d in DOMAINS for x in ("de", "es")}}
SEED = 11
MAX_EPOCHS = 2
#: Bytes of a leaf in a broadcast.
LEAF_BYTES = 300
#: Hexadecimal digits of a range of the hash, and how often the range in which a budget ends is divided again.
RANGE_DIGITS, RANGE_LEVELS = 2, 3


def domain_of(source: Column) -> Column:
    """Domain of a source: by its number, as the table of documents has no such column."""
    number = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(source, "([0-9]{1,9})", 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0))
    return F.element_at(F.array(*map(F.lit, DOMAINS)), number % len(DOMAINS) + 1)


def weight_of(*path: Column) -> Column:
    named = [(k, w) for k, w in WEIGHTS.items() if len(k) == len(path)]
    out = F.lit(1.0)
    for key, w in named:
        hit = F.lit(True)
        for part, name in zip(path, key, strict=True):
            hit = hit & (part == name)
        out = F.when(hit, F.lit(w)).otherwise(out)
    return out


def shared_out(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """nodes: parent columns, name, weight, most, total (the parent's budget). Adds given."""
    order = Window.partitionBy(*parent).orderBy("ratio", "name")
    at = nodes.withColumn("ratio", F.col("most") / F.col("weight"))
    full = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    at = at.withColumn("level", (F.col("total") - full) / left)
    everyone = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = at.withColumn("level", F.first(F.when(F.col("ratio") > F.col("level"), F.col("level")), ignorenulls=True).over(everyone))
    given = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("weight") * F.col("level")))
    return at.withColumn("given", given).drop("ratio", "level")


def budgets(leaves: DataFrame, total: float | None = None, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """leaves: domain, lang, source, n_docs, n_tokens. Adds given (tokens) to each leaf. total: all tokens if None."""
    own = leaves.withColumn("most", F.col("n_tokens").cast("double") * max_epochs)
    budget = F.lit(float(total)) if total is not None else (F.sum("n_tokens").over(Window.partitionBy())).cast("double")
    at = own.groupBy("domain").agg(F.sum("most").alias("most"), F.sum("n_tokens").alias("n_tokens")).withColumn("total", budget)
    at = at.withColumn("name", F.col("domain")).withColumn("weight", weight_of(F.col("domain"))).withColumn("root", F.lit(0))
    got = shared_out(at, ["root"]).select("domain", F.col("given").alias("total"))
    at = own.groupBy("domain", "lang").agg(F.sum("most").alias("most")).join(got, "domain")
    at = at.withColumn("name", F.col("lang")).withColumn("weight", weight_of(F.col("domain"), F.col("lang")))
    got = shared_out(at, ["domain"]).select("domain", "lang", F.col("given").alias("total"))
    at = own.join(got, ["domain", "lang"]).withColumn("name", F.col("source")).withColumn("weight", weight_of(*map(F.col, LEVELS)))
    return shared_out(at, ["domain", "lang"]).select(*LEVELS, "n_docs", "n_tokens", F.floor("given").cast("bigint").alias("given"))


def place(epoch: Column, id_col: Column, seed: int) -> Column:
    """Hash that orders an epoch: 32 hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_col.cast("string"), F.lit(""))))


def plan(docs: DataFrame, seed: int = SEED, total: float | None = None, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row for each leaf: budget, whole epochs, and the hash up to which the last epoch is taken ('' for none of it).

    docs: doc_id, domain, lang, source, n_tokens.
    """
    leaves = docs.groupBy(*LEVELS).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    at = budgets(written(leaves, "leaves"), total, max_epochs)
    # an epoch is whole if its tokens fit; a leaf without tokens has one
    at = at.withColumn("epochs", F.when(F.col("n_tokens") == 0, F.lit(1)).otherwise(F.floor(F.try_divide(F.col("given"), F.col("n_tokens")))).cast("int"))
    at = written(at.withColumn("rest", F.when(F.col("n_tokens") == 0, F.lit(0)).otherwise(F.col("given") - F.col("epochs") * F.col("n_tokens")).cast("bigint")), "budgets")
    at_leaf = few(at, LEAF_BYTES)
    last = docs.join(at_leaf.select(*LEVELS, "epochs", "rest"), list(LEVELS)).where("rest > 0")
    inside = last.select(*LEVELS, place(F.col("epochs"), F.col("doc_id"), seed).alias("place"), "n_tokens", F.col("rest").alias("wanted"))
    # the range of hashes in which the budget ends, then the range of that range, and so on
    for level in range(RANGE_LEVELS):
        inside = inside.withColumn("range", F.substring("place", RANGE_DIGITS * level + 1, RANGE_DIGITS))
        sums = inside.groupBy(*LEVELS, "wanted", "range").agg(F.sum("n_tokens").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("range"))
        edges = sums.withColumn("upto", upto).where("upto > wanted").groupBy(*LEVELS).agg(F.min(F.struct("range", (F.col("wanted") - F.col("upto") + F.col("n")).alias("left"))).alias("e"))
        edges = few(written(edges.select(*LEVELS, F.col("e.range").alias("edge"), F.col("e.left").alias("left")), f"edges-{level}"), LEAF_BYTES)
        inside = written(inside.drop("wanted").join(edges, list(LEVELS)).where(F.col("range") == F.col("edge")).select(*LEVELS, "place", "n_tokens", F.col("left").alias("wanted"), F.substring("place", 1, RANGE_DIGITS * (level + 1)).alias("first")), f"range-{level}")
    order = Window.partitionBy(*LEVELS).orderBy("place")
    ends = inside.withColumn("upto", F.sum("n_tokens").over(order)).groupBy(*LEVELS).agg(F.max(F.when(F.col("upto") <= F.col("wanted"), F.col("place"))).alias("inner"), F.min("first").alias("edge"))
    # ranges before the edge are taken whole: all hashes below it
    cut = F.coalesce("inner", "edge", F.lit(""))
    return at.join(ends, list(LEVELS), "left").select(*LEVELS, "n_docs", "n_tokens", "given", "epochs", "rest", cut.alias("cut"))


def leaf_columns(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> dict[str, Column]:
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    tokens = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    return {"domain": domain_of(source), "lang": F.coalesce(F.col(lang_col).cast("string"), F.lit("")), "source": source, "n_tokens": tokens}


def mix(docs: DataFrame, id_col: str = "doc_id", seed: int = SEED, total: float | None = None, max_epochs: int = MAX_EPOCHS, carry: list[str] | None = None) -> DataFrame:
    """The chosen rows: row (a struct of the columns of carry, all of docs by default), epoch, domain and n_tokens."""
    own = leaf_columns(docs)
    narrow = written(docs.select(F.col(id_col).alias("doc_id"), *[c.alias(k) for k, c in own.items()]), "leaf-tokens")
    chosen = few(written(plan(narrow, seed, total, max_epochs), "mixing-plan").select(*LEVELS, F.struct("epochs", "cut").alias("plan")), LEAF_BYTES)
    # a row's own columns stay inside a struct, where no name can clash
    at = docs.select(F.struct(*[F.col(c) for c in (docs.columns if carry is None else carry)]).alias("row"), F.col(id_col).alias("id"), *[c.alias(k) for k, c in own.items()]).join(chosen, list(LEVELS))
    none = F.array().cast("array<int>")
    whole = F.when(F.col("plan.epochs") > 0, F.sequence(F.lit(0), F.greatest(F.col("plan.epochs") - 1, F.lit(0)))).otherwise(none)
    last = F.when(place(F.col("plan.epochs"), F.col("id"), seed) <= F.col("plan.cut"), F.array(F.col("plan.epochs"))).otherwise(none)
    return at.select("row", F.explode(F.concat(whole, last)).alias("epoch"), "domain", "n_tokens")


def op8_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mix(load(spark, sf_dir, "documents"), carry=["doc_id", "lang", "source"])
    return got.select("row.doc_id", F.col("epoch").cast("bigint").alias("epoch"), "domain", "row.lang", "row.source", "n_tokens")


_WEIGHT_SQL = {
    1: "CASE " + " ".join(f"WHEN domain = '{k[0]}' THEN {w}" for k, w in WEIGHTS.items() if len(k) == 1) + " ELSE 1.0 END::DOUBLE",
    2: "CASE " + " ".join(f"WHEN domain = '{k[0]}' AND lang = '{k[1]}' THEN {w}" for k, w in WEIGHTS.items() if len(k) == 2) + " ELSE 1.0 END::DOUBLE",
    3: "1.0::DOUBLE",
}


def _level_sql(name: str, source: str, parent: str) -> str:
    over = f"PARTITION BY {parent} ORDER BY most / weight, name"
    return f"""
{name}_r AS (SELECT *, (total - coalesce(sum(most) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER ({over} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM {source}),
{name}_l AS (SELECT *, first_value(CASE WHEN most / weight > lvl THEN lvl END IGNORE NULLS) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS water FROM {name}_r),
{name} AS (SELECT *, CASE WHEN water IS NULL THEN most ELSE least(most, weight * water) END AS given FROM {name}_l)"""


OP8_SQL = f"""
WITH d AS (
  SELECT doc_id, lang AS lang0, source AS source0, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         (['web', 'news', 'books', 'forum'])[coalesce(try_cast(regexp_extract(source, '([0-9]{{1,9}})', 1) AS INT), 0) % 4 + 1] AS domain,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens
  FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS n_tokens, sum(n_tokens)::DOUBLE * {MAX_EPOCHS} AS most FROM d GROUP BY ALL),
n1 AS (SELECT 0 AS root, domain, domain AS name, sum(most) AS most, (SELECT sum(n_tokens)::DOUBLE FROM leaf) AS total, {_WEIGHT_SQL[1]} AS weight FROM leaf GROUP BY domain),
{_level_sql('g1', 'n1', 'root')},
n2 AS (SELECT leaf.domain, lang, lang AS name, sum(leaf.most) AS most, any_value(g1.given) AS total, CASE WHEN true THEN {_WEIGHT_SQL[2].replace('domain =', 'leaf.domain =')} END AS weight FROM leaf JOIN g1 ON leaf.domain = g1.domain GROUP BY leaf.domain, lang),
{_level_sql('g2', 'n2', 'domain')},
n3 AS (SELECT leaf.domain, leaf.lang, source, source AS name, n_tokens, leaf.most, g2.given AS total, {_WEIGHT_SQL[3]} AS weight FROM leaf JOIN g2 ON leaf.domain = g2.domain AND leaf.lang = g2.lang),
{_level_sql('g3', 'n3', 'domain, lang')},
b AS (SELECT domain, lang, source, CASE WHEN n_tokens = 0 THEN 1 ELSE floor(given)::BIGINT // n_tokens END AS epochs, CASE WHEN n_tokens = 0 THEN 0 ELSE floor(given)::BIGINT % n_tokens END AS rest FROM g3),
c AS (SELECT d.*, epochs, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}:' || epochs || ':' || coalesce(doc_id::VARCHAR, ''))) AS upto FROM d JOIN b USING (domain, lang, source)),
e AS (
  SELECT *, unnest(range(0, epochs)) AS epoch FROM c
  UNION ALL SELECT *, epochs AS epoch FROM c WHERE upto <= rest AND rest > 0)
SELECT doc_id, epoch::BIGINT AS epoch, domain, lang0 AS lang, source0 AS source, n_tokens::BIGINT AS n_tokens FROM e
"""
