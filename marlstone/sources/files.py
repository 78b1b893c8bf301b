"""Shared drives, uploads and the file store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.operators.convert import converter_for, extension_of
from marlstone.operators.tables import written

#: Native types and what they are exported as; types that are downloaded; limits.
EXPORTS = {"document": "text/markdown", "spreadsheet": "text/csv", "presentation": "text/plain"}
NATIVE = "application/vnd.google-apps"
DOWNLOADS = ("application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "text/plain", "text/markdown", "text/csv", "text/html")
MAX_BYTES = 25 * 1024 * 1024
REFUSED = (".doc", ".xlsx", ".xls", ".pptx")


def drive_plan(mime: Column) -> Column:
    """struct(export, mime_type) of what to do with a file; null: skip it."""
    plan = F.when(mime.isin(*DOWNLOADS), F.struct(F.lit(False).alias("export"), mime.alias("mime_type")))
    for name, to in EXPORTS.items():
        plan = F.when(mime == f"{NATIVE}.{name}", F.struct(F.lit(True).alias("export"), F.lit(to).alias("mime_type"))).otherwise(plan)
    return plan


def drive_listing(files: DataFrame, roots: list[str], seen: DataFrame, max_depth: int = 10) -> DataFrame:
    """Files under the roots that changed and can be read. files: id, parent_id, name, mime_type, size, modified; seen: id, modified."""
    folders = files.where(F.col("mime_type") == f"{NATIVE}.folder").select("id", "parent_id")
    level = files.sparkSession.createDataFrame([(r,) for r in roots], "folder string")
    reached = level
    for _ in range(max_depth):
        level = written(folders.join(level, folders["parent_id"] == level["folder"]).select(F.col("id").alias("folder")).join(reached, "folder", "left_anti").distinct(), "drive-folders")
        if level.isEmpty():
            break
        reached = reached.unionByName(level)
    own = files.join(reached.withColumnRenamed("folder", "parent_id"), "parent_id", "left_semi").withColumn("plan", drive_plan(F.col("mime_type")))
    own = own.where(F.col("plan").isNotNull() & (F.coalesce("size", F.lit(0)) <= MAX_BYTES))
    return own.join(seen.select("id", "modified"), ["id", "modified"], "left_anti").select("id", "name", "modified", "plan.*")


def incremental(listing: DataFrame, seen: DataFrame, key: str = "external_id", mark: str = "fingerprint") -> DataFrame:
    """Rows whose key is new or whose mark differs. The next cursor is the listing itself: what left it is forgotten, not deleted."""
    return listing.join(seen.select(key, mark), [key, mark], "left_anti")


def upload_refusal(filename: Column, mime: Column, size: Column) -> Column:
    """Why an upload is refused; null if it is taken."""
    return (
        F.when(F.coalesce(size, F.lit(0)) == 0, F.lit("empty"))
        .when(size > MAX_BYTES, F.lit("too large"))
        .when(extension_of(filename).isin(*REFUSED), F.lit("unsupported format"))
        .when(converter_for(mime, filename).isNull() & (extension_of(filename) != ".pdf"), F.lit("unsupported format"))
    )


def upload_fields(fields: DataFrame) -> DataFrame:
    """Form fields with texts trimmed, empty ones null, dates read, tags split. fields: title, tags, effective_from, expires_at."""
    blank = lambda c: F.nullif(tx.trim(F.col(c)), F.lit(""))
    return fields.select(
        *[c for c in fields.columns if c not in ("title", "tags", "effective_from", "expires_at")],
        blank("title").alias("title"),
        F.filter(F.transform(F.split(F.coalesce("tags", F.lit("")), ","), tx.trim), lambda x: x != "").alias("tags"),
        *[F.try_to_timestamp(blank(c)).alias(c) for c in ("effective_from", "expires_at")],
    )


def read_files(spark, path: str) -> DataFrame:
    """path, length and content of the files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
