"""Storage maintenance operations and table, schema, catalog, workspace inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.context import Ctx
from spendscope.functions.measures import desc, minutes_between, rnd, top
from spendscope.plans.registry import report

LOOKBACK = 30


def _ops(ctx: Ctx) -> DataFrame:
    return ctx.recent_ts("storage.optimization_operations", "start_time", LOOKBACK)


@report("optimization_ops")
def optimization_ops(ctx: Ctx, n: int | None = None) -> DataFrame:
    """The 500 latest operations; the counts below are over all of the window."""
    rows = _ops(ctx).select(
        "catalog_name", "schema_name", "table_name", "operation_type", "operation_status",
        F.col("start_time").alias("started_at"), rnd(minutes_between("start_time", "end_time"), 1).alias("duration_min"),
        "operation_id",
    )
    return top(rows, n, desc("started_at"))


@report("optimization_summary")
def optimization_summary(ctx: Ctx) -> DataFrame:
    """Outcomes per operation; both SUCCESS and SUCCEEDED count."""
    status = F.upper("operation_status")
    ok = F.contains(status, F.lit("SUCCE"))
    return _ops(ctx).groupBy("operation_type").agg(
        F.count("*").alias("total"), F.count_if(ok).alias("success"),
        F.count_if(~ok & F.contains(status, F.lit("FAIL"))).alias("failed"),
    ).orderBy(desc("total"))


def _user_tables(ctx: Ctx) -> DataFrame:
    return ctx.table("information_schema.tables").where(
        (F.col("table_schema") != "information_schema") & ~F.col("table_catalog").isin("system", "samples")
        & F.col("table_type").isin("MANAGED", "EXTERNAL")
    ).withColumnsRenamed({"table_catalog": "catalog_name", "table_schema": "schema_name"})


@report("table_inventory")
def table_inventory(ctx: Ctx) -> DataFrame:
    return _user_tables(ctx).select(
        "catalog_name", "schema_name", "table_name", "table_type", F.col("created").alias("created_at")
    ).orderBy("catalog_name", "schema_name", "table_name")


@report("schema_summary")
def schema_summary(ctx: Ctx) -> DataFrame:
    rows = _user_tables(ctx).groupBy("catalog_name", "schema_name").agg(F.count("*").alias("table_count"))
    return rows.orderBy(desc("table_count"), "catalog_name", "schema_name")


@report("catalog_summary")
def catalog_summary(ctx: Ctx) -> DataFrame:
    """One row per schema with the totals of its catalog."""
    schemas = schema_summary(ctx)
    totals = schemas.groupBy("catalog_name").agg(
        F.count("*").alias("catalog_schemas"), F.sum("table_count").alias("catalog_tables")
    )
    return schemas.join(totals, "catalog_name").orderBy(desc("catalog_tables"), "catalog_name", desc("table_count"))


@report("table_types")
def table_types(ctx: Ctx) -> DataFrame:
    return _user_tables(ctx).groupBy("table_type").agg(F.count("*").alias("table_count")).orderBy(desc("table_count"))


@report("workspace_inventory")
def workspace_inventory(ctx: Ctx) -> DataFrame:
    """Workspaces; a blank cloud is guessed from the host name."""
    host = F.lower(F.coalesce("workspace_url", F.lit("")))
    guess = F.when(F.contains(host, F.lit("azure")), "Azure").when(F.contains(host, F.lit("aws")), "AWS").otherwise("GCP")
    return ctx.table("access.workspaces_latest").select(
        "workspace_id", "workspace_name", "workspace_url", "workspace_status",
        F.coalesce(F.nullif("cloud", F.lit("")), guess).alias("cloud"), "region",
    ).orderBy("workspace_name")


@report("storage_summary")
def storage_summary(ctx: Ctx) -> DataFrame:
    ops, types = _ops(ctx), F.col("table_type")
    n = F.count("*").alias("n")
    return schema_summary(ctx).agg(
        F.count_distinct("catalog_name").alias("total_catalogs"), F.count("*").alias("total_schemas"),
        F.coalesce(F.sum("table_count"), F.lit(0)).alias("total_tables"),
    ).withColumns({
        "managed_tables": _user_tables(ctx).agg(F.count_if(types == "MANAGED").alias("n")).scalar(),
        "external_tables": _user_tables(ctx).agg(F.count_if(types == "EXTERNAL").alias("n")).scalar(),
        "optimization_ops": ops.agg(n).scalar(),
        "op_types": ops.agg(F.count_distinct("operation_type").alias("n")).scalar(),
        "total_workspaces": ctx.table("access.workspaces_latest").agg(n).scalar(),
    })
