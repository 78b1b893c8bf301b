"""Tables of one tenant. There is no other reader, and without a tenant there are no rows to be had."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ID = re.compile(r"[a-z0-9_-]{8,64}", re.I)
#: Models that every row of which belongs to a tenant.
SCOPED = "knowledge_source document document_version chunk conversation message contact knowledge_gap outbox_event usage_record api_key audit_log prompt_deployment eval_suite eval_run ai_config brand_dna".split()


class TenantError(PermissionError):
    pass


class TenantCatalog:
    """table(name) is always filtered by the tenant, which partition pruning turns into fewer files."""

    def __init__(self, spark: SparkSession, root: str, tenant_id: str | None, column: str = "tenant_id", reason: str | None = None):
        if reason is None and (not tenant_id or not tenant_id.strip()):
            raise TenantError("no tenant")
        self.spark, self.root, self.tenant_id, self.column, self.reason = spark, root, tenant_id, column, reason

    @classmethod
    def system(cls, spark: SparkSession, root: str, reason: str) -> TenantCatalog:
        """Access across tenants, which states its reason."""
        if not reason.strip():
            raise TenantError("access across tenants needs a reason")
        return cls(spark, root, None, reason=reason)

    def of(self, rows: DataFrame) -> DataFrame:
        if self.reason is not None:
            return rows
        if self.column not in rows.columns:
            raise TenantError(f"rows without {self.column}")
        return rows.where(F.col(self.column) == F.lit(self.tenant_id))

    def table(self, name: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return self.of(rows) if name in SCOPED or self.column in rows.columns else rows

    def write(self, rows: DataFrame, name: str, mode: str = "append") -> None:
        """Rows of this tenant only, in a folder of its own."""
        if self.reason is None:
            rows = rows.withColumn(self.column, F.lit(self.tenant_id))
        rows.write.mode(mode).partitionBy(self.column).parquet(f"{self.root}/{name}.parquet")


def valid_tenant_id(c: Column) -> Column:
    return c.rlike(rf"(?i)\A{_ID.pattern}\z")


def bearer(header: Column) -> Column:
    return F.nullif(F.regexp_extract(header, r"\ABearer\s+(\S+)\z", 1), F.lit(""))


def authenticate(requests: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """requests: request_id, header, scope. A tenant if the key is known, neither revoked nor expired, and has the scope.

    Unknown, revoked and expired keys are told apart nowhere: all are unauthorized.
    """
    at = requests.withColumn("key_hash", F.sha2(bearer(F.col("header")), 256)).join(keys.select("key_hash", "tenant_id", "scopes", "revoked_at", "expires_at"), "key_hash", "left")
    good = F.col("tenant_id").isNotNull() & F.col("revoked_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > now))
    may = F.array_contains("scopes", F.col("scope")) | F.array_contains("scopes", "*")
    return at.select("request_id", F.when(good & may, F.col("tenant_id")).alias("tenant_id"), F.when(~F.coalesce(good, F.lit(False)), "unauthorized").when(~may, "forbidden").otherwise("ok").alias("outcome"))


def redacted(config: Column, secret: list[str]) -> Column:
    """A map of settings with the secret ones masked; only whether they are set is seen."""
    return F.transform_values(config, lambda k, v: F.when(k.isin(*secret) & (F.coalesce(v, F.lit("")) != ""), F.lit("********")).otherwise(v))


def sealed(value: Column, key: Column) -> Column:
    return F.base64(F.aes_encrypt(value, key, F.lit("GCM")))


def opened(value: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(value), key, F.lit("GCM")).cast("string")
