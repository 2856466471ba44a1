"""Tenants: keys, injection, isolation, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lanternlog.functions import fixed
from lanternlog.functions.ids import key_hash
from lanternlog.params import DEFAULTS, Params


def key_dimension(api_keys: DataFrame, projects: DataFrame) -> DataFrame:
    """Keys in force with their tenant."""
    live = api_keys.where(~F.col("revoked")).select("key_prefix", "key_hash", "project_id")
    owners = projects.select(F.col("id").alias("project_id"), "tenant_id", "org_id")
    return live.join(owners, "project_id")


def resolve_keys(requests: DataFrame, api_keys: DataFrame, projects: DataFrame) -> DataFrame:
    """Requests (column ``api_key``) with the tenant of their key."""
    dim = key_dimension(api_keys, projects)
    return requests.withColumn("key_hash", key_hash(F.col("api_key"))).join(dim, "key_hash").drop("api_key")


def rejected_requests(requests: DataFrame, api_keys: DataFrame, projects: DataFrame) -> DataFrame:
    """Requests whose key is unknown or revoked."""
    dim = key_dimension(api_keys, projects).select("key_hash")
    return requests.withColumn("key_hash", key_hash(F.col("api_key"))).join(dim, "key_hash", "left_anti")


def inject_tenant(attributes: Column, tenant: Column) -> Column:
    """Resource attributes with the verified tenant instead of the caller's."""
    kept = F.filter(attributes, lambda a: a["key"] != "tenant_id")
    own = F.struct(
        F.lit("tenant_id").alias("key"),
        F.struct(
            tenant.alias("stringValue"),
            *[
                F.lit(None).cast("string").alias(n)
                for n in ("intValue", "doubleValue", "boolValue", "arrayValue", "kvlistValue")
            ],
        ).alias("value"),
    )
    return F.array_append(F.coalesce(kept, F.array().cast("array<struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:string,boolValue:string,arrayValue:string,kvlistValue:string>>>")), own)


def default_tenant(tenant: Column, p: Params = DEFAULTS) -> Column:
    return F.coalesce(tenant, F.lit(p.default_tenant))


def strip_tenant(fields: Column) -> Column:
    """Request fields without the tenant names a caller may not set."""
    return F.map_filter(fields, lambda k, v: ~k.isin(fixed.TENANT_FIELDS))


def for_tenant(df: DataFrame, tenant: str | None) -> DataFrame:
    """Rows of one tenant; every query goes through this filter."""
    return df.where(F.col("tenant_id") == tenant) if tenant is not None else df


def tenant_quota(requests: DataFrame, p: Params = DEFAULTS, quota: int | None = None) -> DataFrame:
    """Requests per tenant and minute, and whether they exceed the quota."""
    limit = p.ingest_quota_rpm if quota is None else quota
    return (
        requests.groupBy("tenant_id", F.window("ts", "1 minute").alias("w"))
        .agg(F.count(F.lit(1)).alias("requests"))
        .select(
            "tenant_id", F.col("w.start").alias("minute"), "requests",
            (F.col("requests") > limit).alias("over_quota"),
        )
    )
