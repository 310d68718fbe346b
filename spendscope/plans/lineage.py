"""Data lineage, model serving traffic, ML registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.context import Ctx
from spendscope.functions.measures import desc, rnd, share_pct, top
from spendscope.plans.registry import report

LOOKBACK = 30


def _full_name(side: str):
    parts = [F.coalesce(f"{side}_{p}", F.lit("")) for p in ("catalog", "schema", "table")]
    return F.concat_ws(".", *parts)


@report("table_lineage_edges")
def table_lineage_edges(ctx: Ctx) -> DataFrame:
    """All distinct source -> target pairs of the window."""
    rows = ctx.recent_ts("access.table_lineage", "event_time", LOOKBACK)
    return rows.select(_full_name("source").alias("source"), _full_name("target").alias("target")).distinct()


@report("column_lineage")
def column_lineage(ctx: Ctx, n: int | None = None) -> DataFrame:
    """The 5000 latest column events."""
    rows = ctx.recent_ts("access.column_lineage", "event_time", LOOKBACK).select(
        "source_catalog", "source_schema", "source_table", "source_column", "target_catalog", "target_schema",
        "target_table", "target_column", "event_time",
    )
    return top(rows, n, desc("event_time"))


@report("lineage_tables")
def lineage_tables(ctx: Ctx) -> DataFrame:
    """Every table of the lineage graph with its number of edges in and out."""
    ends = F.explode(F.array(
        F.struct(F.col("source").alias("table_name"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("target").alias("table_name"), F.lit(0).alias("o"), F.lit(1).alias("i")),
    )).alias("e")
    return table_lineage_edges(ctx).select(ends).groupBy(F.col("e.table_name").alias("table_name")).agg(
        F.sum("e.o").alias("edges_out"), F.sum("e.i").alias("edges_in")
    )


@report("serving_daily")
def serving_daily(ctx: Ctx) -> DataFrame:
    return _serving_daily(ctx).withColumn("avg_tokens", rnd("avg_tokens", 1)).orderBy("day", desc("request_count"))


def _serving_daily(ctx: Ctx) -> DataFrame:
    rows = ctx.recent_ts("serving.endpoint_usage", "request_time", LOOKBACK)
    return rows.groupBy(F.col("served_entity_name").alias("entity_name"), F.to_date("request_time").alias("day")).agg(
        F.count("*").alias("request_count"), F.avg("total_token_count").alias("avg_tokens"),
        F.count_if(F.col("status_code") >= 400).alias("error_count"),
    )


def _entities(ctx: Ctx) -> DataFrame:
    return ctx.table("serving.served_entities").select("endpoint_name", F.col("served_entity_name").alias("entity_name"))


@report("join_endpoint_outer")
def join_endpoint_outer(ctx: Ctx) -> DataFrame:
    """Endpoints and used entities side by side: mapped where known, kept where only one side has it."""
    used = _serving_daily(ctx).groupBy("entity_name").agg(F.sum("request_count").alias("requests"))
    return _entities(ctx).join(used, "entity_name", "full_outer")


@report("serving_summary")
def serving_summary(ctx: Ctx) -> DataFrame:
    """Totals per endpoint, unused ones included; an entity without endpoint stands for itself."""
    rows = _serving_daily(ctx).join(_entities(ctx), "entity_name", "full_outer").withColumn(
        "endpoint_name", F.coalesce("endpoint_name", "entity_name")
    )
    tokens = F.round(F.col("avg_tokens").cast("decimal(28,10)"), 1).cast("double")
    counted = F.when(tokens > 0, F.col("request_count"))
    out = rows.groupBy("endpoint_name").agg(
        F.coalesce(F.sum("request_count"), F.lit(0)).alias("total_requests"),
        F.coalesce(F.sum("error_count"), F.lit(0)).alias("total_errors"),
        F.count("day").alias("active_days"),
        F.coalesce(rnd(F.try_divide(F.sum(tokens * counted), F.sum(counted)), 1), F.lit(0.0)).alias("avg_tokens"),
    )
    return out.withColumn("error_rate", share_pct("total_errors", "total_requests")).orderBy(desc("total_requests"))


@report("ml_experiments")
def ml_experiments(ctx: Ctx, n: int | None = None) -> DataFrame:
    rows = ctx.table("mlflow.experiments_latest").select(
        "experiment_id", F.col("name").alias("experiment_name"), "lifecycle_stage",
        F.timestamp_millis("creation_time").alias("created_at"), F.timestamp_millis("last_update_time").alias("updated_at"),
    )
    return top(rows, n, desc("updated_at"))


@report("ml_models")
def ml_models(ctx: Ctx, n: int | None = None) -> DataFrame:
    rows = ctx.table("mlflow.registered_models_latest").select(
        F.col("name").alias("model_name"), F.timestamp_millis("creation_timestamp").alias("created_at"),
        F.timestamp_millis("last_updated_timestamp").alias("updated_at"), F.col("user_id").alias("owner"),
    )
    return top(rows, n, desc("updated_at"))


def _ml_runs(ctx: Ctx) -> DataFrame:
    return ctx.recent_ts("mlflow.runs_latest", "start_time", LOOKBACK)


@report("ml_runs")
def ml_runs(ctx: Ctx, n: int | None = None) -> DataFrame:
    rows = _ml_runs(ctx).select(
        "run_id", "experiment_id", "status", F.col("start_time").alias("started_at"), F.col("end_time").alias("ended_at"),
        F.col("user_id").alias("user_email"),
    )
    return top(rows, n, desc("started_at"))


@report("ml_runs_summary")
def ml_runs_summary(ctx: Ctx) -> DataFrame:
    status = F.col("status")
    return _ml_runs(ctx).agg(
        F.count("*").alias("total_runs"), F.count_if(status == "FINISHED").alias("finished"),
        F.count_if(status == "FAILED").alias("failed"),
    ).withColumn("success_rate", share_pct("finished", "total_runs"))
