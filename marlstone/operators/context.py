"""Packing context under token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as tx

#: Shares of what remains, floors, slots by priority, slots that are never cut.
SHARES = {"rules": 0.10, "liveData": 0.15, "retrieved": 0.50, "customer": 0.05, "conversation": 0.15, "dnaVoice": 0.05}
FLOORS = {"rules": 600}
PRIORITY = ("identity", "dnaCore", "rules", "liveData", "retrieved", "customer", "conversation", "dnaVoice")
UNCUT = ("identity", "dnaCore")
#: Intent, slots, retrieval depth.
RECIPES = {
    "factual_lookup": (("identity", "dnaCore", "rules", "retrieved"), 5),
    "conversational": (("identity", "dnaCore", "rules", "retrieved", "conversation", "dnaVoice"), 8),
    "customer_specific": (("identity", "dnaCore", "rules", "retrieved", "conversation", "customer", "liveData", "dnaVoice"), 8),
    "greeting": (("identity", "dnaCore", "dnaVoice"), 0),
    "needs_planning": (("identity", "dnaCore", "rules", "retrieved", "conversation", "customer", "liveData", "dnaVoice"), 12),
}
DEFAULT_RECIPE = "conversational"


def permitted(required: Column, scopes: Column) -> Column:
    """True if every scope that a chunk asks for is among the actor's."""
    return F.size(F.array_except(F.coalesce(required, F.array().cast("array<string>")), scopes)) == 0


def share_for(slot: str, remaining: Column) -> Column:
    if slot not in SHARES:
        raise ValueError(f"slot {slot!r} has no share")
    part = F.greatest(F.floor(remaining * SHARES[slot]), F.lit(FLOORS.get(slot, 0)))
    return F.least(part, F.greatest(remaining, F.lit(0))).cast("bigint")


def remaining_after(total: Column, fixed: Column) -> Column:
    """What is left after the slots that are never cut; an error if they don't fit."""
    return F.when(fixed <= total, total - fixed).otherwise(F.raise_error(F.concat(F.lit("fixed slots need "), fixed.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" tokens"))))


def greedy(items: Column, available: Column) -> Column:
    """struct(used, kept) of an array of struct(cost, ...), in its order: what does not fit is passed over, later items may still fit."""
    kind = F.slice(items, 1, 0)
    start = F.struct(F.lit(0).cast("bigint").alias("used"), kind.alias("kept"))
    fits = lambda acc, x: acc["used"] + x["cost"] <= available
    return F.aggregate(items, start, lambda acc, x: F.when(fits(acc, x), F.struct((acc["used"] + x["cost"]).cast("bigint").alias("used"), F.array_append(acc["kept"], x).alias("kept"))).otherwise(acc))


def pack_chunks(chunks: DataFrame, available: int, key: str) -> DataFrame:
    """key, used, kept (ids in order), dropped. chunks: key, id, score, cost. By score, then id."""
    rows = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("id").alias("id"), F.col("cost").cast("bigint").alias("cost")))).alias("items"))
    at = rows.withColumn("p", greedy(F.col("items"), F.lit(available)))
    return at.select(key, F.col("p.used").alias("used"), F.transform("p.kept", lambda x: x["id"]).alias("kept"), (F.size("items") - F.size("p.kept")).cast("bigint").alias("dropped"))


def pack_conversation(turns: DataFrame, available: int, key: str = "conv_id", order: str = "turn", text_col: str = "text") -> DataFrame:
    """The newest turns that fit; the first that does not ends it."""
    cost = tx.token_estimate(F.col(text_col))
    newest = Window.partitionBy(key).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return turns.withColumn("cost", cost).withColumn("used", F.sum("cost").over(newest)).where(F.col("used") <= available)


def recipe(intent: Column, what: str) -> Column:
    """slots or depth of an intent; others are conversational."""
    at = 0 if what == "slots" else 1
    value = lambda r: F.array(*map(F.lit, r[0])) if at == 0 else F.lit(r[1])
    out = value(RECIPES[DEFAULT_RECIPE])
    for name, r in RECIPES.items():
        out = F.when(intent == name, value(r)).otherwise(out)
    return out


def should_retrieve(intent: Column) -> Column:
    return F.array_contains(recipe(intent, "slots"), "retrieved") & (recipe(intent, "depth") > 0)


def package_hash(*columns: str) -> Column:
    """First 32 digits of the SHA-256 of the JSON of columns, in the order given."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 32)


def missing_prohibitions(required: Column, present: Column) -> Column:
    return F.array_except(required, present)


def assemble(requests: DataFrame) -> DataFrame:
    """Slots filled by priority, each with its share of what the ones before left.

    requests: request_id, total, fixed, rules and live and chunks and turns (arrays
    of struct(cost, id), by descending priority or score, turns oldest first),
    customer_cost, voice_cost (null: absent). Adds kept ids, used and notes.
    """
    zero = F.lit(0).cast("bigint")
    at = requests.withColumn("left0", remaining_after(F.col("total"), F.col("fixed")))
    for k, (slot, name) in enumerate((("rules", "rules"), ("liveData", "live"), ("retrieved", "chunks"))):
        at = at.withColumn(f"p_{name}", greedy(F.col(name), share_for(slot, F.col(f"left{k}")))).withColumn(f"left{k + 1}", F.col(f"left{k}") - F.col(f"p_{name}")["used"])
    customer = F.col("customer_cost").isNotNull() & (F.col("customer_cost") <= share_for("customer", F.col("left3")))
    at = at.withColumn("keeps_customer", customer).withColumn("left4", F.col("left3") - F.when(F.col("keeps_customer"), F.col("customer_cost")).otherwise(zero))
    limit = share_for("conversation", F.col("left4"))
    start = F.struct(zero.alias("used"), F.lit(False).alias("full"), F.slice(F.col("turns"), 1, 0).alias("kept"))
    packed = F.aggregate(
        F.reverse("turns"),
        start,
        lambda acc, x: F.when(~acc["full"] & (acc["used"] + x["cost"] <= limit), F.struct((acc["used"] + x["cost"]).cast("bigint").alias("used"), F.lit(False).alias("full"), F.concat(F.array(x), acc["kept"]).alias("kept"))).otherwise(
            F.struct(acc["used"].alias("used"), F.lit(True).alias("full"), acc["kept"].alias("kept"))
        ),
    )
    at = at.withColumn("p_turns", packed).withColumn("left5", F.col("left4") - F.col("p_turns")["used"])
    voice = F.col("voice_cost").isNotNull() & (F.col("voice_cost") <= share_for("dnaVoice", F.col("left5")))
    at = at.withColumn("keeps_voice", voice)
    ids = lambda name: F.transform(F.col(f"p_{name}")["kept"], lambda x: x["id"]).alias(f"kept_{name}")
    note = lambda slot, name: F.when(F.size(name) > F.size(F.col(f"p_{name}")["kept"]), F.struct(F.lit(slot).alias("slot"), (F.size(name) - F.size(F.col(f"p_{name}")["kept"])).alias("dropped"), F.size(F.col(f"p_{name}")["kept"]).alias("kept")))
    gone = lambda slot, cost, kept: F.when(F.col(cost).isNotNull() & ~F.col(kept), F.struct(F.lit(slot).alias("slot"), F.lit(1).alias("dropped"), F.lit(0).alias("kept")))
    notes = F.filter(F.array(note("rules", "rules"), note("liveData", "live"), note("retrieved", "chunks"), gone("customer", "customer_cost", "keeps_customer"), note("conversation", "turns"), gone("dnaVoice", "voice_cost", "keeps_voice")), lambda x: x.isNotNull())
    used = F.col("total") - F.col("left5") + F.when(F.col("keeps_voice"), F.col("voice_cost")).otherwise(zero)
    return at.select("request_id", *map(ids, ("rules", "live", "chunks", "turns")), "keeps_customer", "keeps_voice", used.cast("bigint").alias("used"), notes.alias("truncated"))
