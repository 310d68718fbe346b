"""Per-user JSON configuration: reading, normalising, upserting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendscope.sources.sinks import upsert

CONFIG = "tabs array<string>, workspaces array<string>, tags array<map<string,string>>"


def _tag(entry: Column) -> Column:
    """{key, value} pairs as they are; otherwise the first entry of the map."""
    first = F.get(F.map_entries(entry), F.lit(0))
    listed = F.map_contains_key(entry, "key")
    return F.struct(
        F.when(listed, entry["key"]).otherwise(first["key"]).alias("key"),
        F.when(listed, F.coalesce(entry["value"], F.lit(""))).otherwise(first["value"]).alias("value"),
    )


def parse_permissions(df: DataFrame) -> DataFrame:
    """email, allowed_tabs, workspaces, tags, is_valid. Unreadable JSON gives an empty configuration."""
    cfg = F.from_json("config", CONFIG, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    shaped = F.trim("config").startswith("{")
    tags = F.transform(F.coalesce("_c.tags", F.array().cast("array<map<string,string>>")), _tag)
    return df.withColumn("_c", cfg).select(
        F.lower("email").alias("email"), F.col("_c.tabs").alias("allowed_tabs"), F.col("_c.workspaces").alias("workspaces"),
        tags.alias("tags"), (shaped & F.try_parse_json("config").isNotNull()).alias("is_valid"), "updated_at", "updated_by",
    )


def permissions_of(df: DataFrame, email: str) -> DataFrame:
    return parse_permissions(df.where(F.lower("email") == email.strip().lower()))


def upsert_permissions(current: DataFrame, changes: DataFrame, stamp: Column) -> DataFrame:
    """Apply a batch of changes by lower-cased email; a NULL config removes the user.

    Of several changes to one user the last by ``change_no`` counts. Changed rows carry ``stamp`` and the
    change's author.
    """
    last = changes.groupBy(F.lower("email").alias("email")).agg(
        F.max_by(F.struct("config", "updated_by"), "change_no").alias("_c")
    ).select("email", "_c.config", "_c.updated_by", stamp.alias("updated_at"))
    base = current.withColumn("email", F.lower("email"))
    return upsert(
        base, last.where("config IS NOT NULL").select(*base.columns), ["email"], last.where("config IS NULL").select("email")
    )
