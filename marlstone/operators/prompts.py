"""Prompt deployments and prompt files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pick(requests: DataFrame, deployments: DataFrame) -> DataFrame:
    """request_id, version_id: the active deployment that each request is served.

    requests: request_id, key, tenant_id, roll in [0, 100); deployments: key,
    tenant_id (null: global), traffic_percent, version_id, deployed_at, is_active.
    A tenant's own deployments exclude global ones; the first whose running
    traffic exceeds the roll is served, the last if none does; newest first. A
    request without any deployment has no row.
    """
    own = deployments.where("is_active").select("key", F.col("tenant_id").alias("owner"), "traffic_percent", "version_id", "deployed_at")
    at = requests.join(own, "key").where(F.col("owner").isNull() | (F.col("owner") == F.col("tenant_id")))
    every = Window.partitionBy("request_id")
    at = at.withColumn("scoped", F.max(F.col("owner").isNotNull()).over(every)).where(~F.col("scoped") | F.col("owner").isNotNull())
    order = every.orderBy(F.desc("deployed_at"), "version_id")
    upto = F.sum("traffic_percent").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = at.withColumn("n", F.row_number().over(order)).withColumn("hit", F.col("roll") < upto)
    served = F.coalesce(F.min(F.when(F.col("hit"), F.struct("n", "version_id"))), F.max(F.struct("n", "version_id")))
    return at.groupBy("request_id").agg(served.alias("s")).select("request_id", F.col("s.version_id").alias("version_id"))


def parse_prompt_file(text: str) -> dict:
    """Front matter of key: value lines between --- marks, then the template."""
    m = re.match(r"---\r?\n([\s\S]*?)\r?\n---\r?\n([\s\S]*)\Z", text)
    if not m:
        raise ValueError("a prompt file starts with front matter")
    head = dict(tuple(x.strip() for x in line.split(":", 1)) for line in m[1].splitlines() if ":" in line and not line.lstrip().startswith("#"))
    if not head.get("key") or not re.fullmatch("[1-9][0-9]*", head.get("version", "")):
        raise ValueError("a prompt file names its key and version")
    return head | {"version": int(head["version"]), "template": m[2].strip()}


def conflicting_versions(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Versions that are stored with another template: versions never change."""
    return files.join(stored.select("key", "version", F.col("template").alias("old")), ["key", "version"]).where(F.col("template") != F.col("old")).select("key", "version")


def seed(files: DataFrame, prompts: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New rows of prompts (key, name) and of versions (key, version, template) of prompt files; a version that changed is an error.

    files: key, name, version, template.
    """
    if bad := conflicting_versions(files, versions).limit(3).collect():
        raise ValueError(f"versions never change: {[(r.key, r.version) for r in bad]}")
    new_prompts = files.groupBy("key").agg(F.max_by("name", "version").alias("name")).join(prompts.select("key"), "key", "left_anti")
    return new_prompts, files.select("key", "version", "template").dropDuplicates(["key", "version"]).join(versions.select("key", "version"), ["key", "version"], "left_anti")


def merged(stored: DataFrame, incoming: DataFrame, *key: str) -> DataFrame:
    """Upsert: incoming rows replace stored ones with the same key."""
    return stored.join(incoming.select(*key), list(key), "left_anti").select(*stored.columns).unionByName(incoming.select(*stored.columns))
