"""Partitioned parquet tables and idempotent upserts into them."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARED_DIR = "spendscope.shared.dir"
COST_PARTITIONS = ("cloud_provider", "usage_date")
COST_KEYS = (
    "cloud_provider", "account_id", "usage_date", "service_name", "sku_description", "region", "resource_group",
)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the one the session names in spark.checkpoint.dir, else in spendscope.shared.dir.

    It must be one that driver and executors share; without it there is nowhere to keep intermediate tables.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(SHARED_DIR, None)
    if not base:
        raise ValueError(f"set spark.checkpoint.dir, or {SHARED_DIR} in the session, to a shared folder")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def write_partitioned(df: DataFrame, path: str, partitions: Sequence[str] = COST_PARTITIONS, mode: str = "overwrite") -> None:
    """Write by partition; overwriting replaces only the partitions that occur in ``df``.

    Rows are spread by partition and row hash with a rebalance hint, so AQE splits a partition that
    holds much of the data over several tasks and merges small ones.
    """
    (
        df.hint("rebalance", *partitions).write.mode(mode).option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions).parquet(path)
    )


def matching(keys: Sequence[str], left: str, right: str):
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], deletes: DataFrame | None = None) -> DataFrame:
    """``target`` with rows of equal key replaced by ``source``, other source rows added, deletes gone.

    NULL keys match NULL keys, so loading the same rows again changes nothing. ``source`` has one row per
    key: ``check_unique`` tells.
    """
    gone = source.select(*keys) if deletes is None else source.select(*keys).unionByName(deletes.select(*keys))
    kept = target.alias("t").join(gone.distinct().alias("s"), matching(keys, "t", "s"), "left_anti")
    return kept.select(*target.columns).unionByName(source.select(*target.columns))


def check_unique(df: DataFrame, keys: Sequence[str]) -> None:
    twice = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys).first()
    if twice:
        raise ValueError(f"more than one row for {twice.asDict()}")


def upsert_partitions(
    spark: SparkSession, path: str, source: DataFrame, keys: Sequence[str] = COST_KEYS,
    partitions: Sequence[str] = COST_PARTITIONS,
) -> None:
    """Upsert into a partitioned table by reading and rewriting only the partitions that ``source`` touches.

    A semi-join on the partition columns finds the stored rows; as a plain equality it lets Spark prune the
    partitions that are read, and NULL partition values are matched beside it. Rows of a key stay in one
    partition, so the partition columns must be among the keys. The source must have one row per key; it is
    used several times and therefore kept for the duration.
    """
    if not set(partitions) <= set(keys):
        raise ValueError("the partition columns must be among the keys")
    stored = spark.read.schema(source.schema).parquet(path)
    source = source.persist()
    try:
        check_unique(source, keys)
        touched = source.select(*partitions).distinct()
        some_null = F.lit(False)
        for p in partitions:
            some_null = some_null | F.col(p).isNull()
        plain = stored.where(~some_null).join(touched, list(partitions), "left_semi")
        rest = stored.where(some_null).alias("t").join(
            touched.where(some_null).alias("s"), matching(partitions, "t", "s"), "left_semi"
        )
        affected = plain.select(*stored.columns).unionByName(rest.select(*stored.columns))
        write_partitioned(upsert(affected, source, keys), path, partitions)
    finally:
        source.unpersist()
