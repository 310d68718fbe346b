"""Query history statistics and the attribution of warehouse cost to users by query time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendscope.context import Ctx
from spendscope.functions import classify as C
from spendscope.functions.measures import desc, rnd, top
from spendscope.operators.pricing import priced_usage
from spendscope.plans.compute import spend_windows, warehouse_workspace
from spendscope.plans.cost import with_workspace
from spendscope.plans.registry import report

HISTORY = "query.history"
LOOKBACK = 90
GIB = 1024.0**3
WAREHOUSE = "compute.warehouse_id"


def _history(ctx: Ctx) -> DataFrame:
    return ctx.recent_ts(HISTORY, "start_time", LOOKBACK).where(F.col("statement_type") != "OTHER")


def _since(ctx: Ctx, days: int) -> Column:
    return F.to_date("start_time") >= F.lit(ctx.back(days, HISTORY))


def _gib(c: Column, places: int = 2) -> Column:
    return rnd(c.cast("double") / GIB, places)


def _seconds(c: Column, places: int) -> Column:
    return rnd(c.cast("double") / 1000, places)


def _volume(ctx: Ctx) -> list[Column]:
    bytes_ = F.col("read_bytes")
    return [
        F.count("*").alias("queries_90d"),
        F.count_if(_since(ctx, 60)).alias("queries_60d"),
        F.count_if(_since(ctx, 30)).alias("queries_30d"),
        _seconds(F.sum("total_duration_ms"), 1).alias("total_duration_sec"),
        _seconds(F.avg("total_duration_ms"), 2).alias("avg_duration_sec"),
        _gib(F.sum(bytes_)).alias("gb_90d"),
        _gib(F.coalesce(F.sum(F.when(_since(ctx, 60), bytes_)), F.lit(0))).alias("gb_60d"),
        _gib(F.coalesce(F.sum(F.when(_since(ctx, 30), bytes_)), F.lit(0))).alias("gb_30d"),
        F.count_if(F.col("error_message").isNotNull()).alias("failed_count"),
    ]


def _user_stats(ctx: Ctx) -> DataFrame:
    return _history(ctx).where(C.is_interactive_query()).groupBy(F.col("executed_by").alias("user_email")).agg(
        *_volume(ctx), F.count_distinct(WAREHOUSE).alias("warehouses_used"),
        F.count_if(F.col("error_message").isNull()).alias("success_count"),
    )


@report("query_user_stats")
def query_user_stats(ctx: Ctx, n: int | None = None) -> DataFrame:
    """Top 200 users by data read, interactive statements only."""
    return top(_user_stats(ctx), n, desc("gb_90d"))


@report("query_daily_trend")
def query_daily_trend(ctx: Ctx) -> DataFrame:
    return _history(ctx).groupBy(F.to_date("start_time").alias("day")).agg(
        F.count("*").alias("query_count"), F.count_distinct("executed_by").alias("unique_users"),
        _gib(F.sum("read_bytes")).alias("gb_scanned"), _seconds(F.avg("total_duration_ms"), 2).alias("avg_duration_sec"),
    ).orderBy("day")


def _statement(*extra: Column) -> list[str | Column]:
    return [
        "statement_id", F.col("executed_by").alias("user_email"), F.col(WAREHOUSE).alias("warehouse_id"), "statement_type",
        F.substring("statement_text", 1, 200).alias("query_preview"),
        F.when(F.col("error_message").isNull(), "FINISHED").otherwise("FAILED").alias("status"),
        _seconds(F.col("total_duration_ms"), 2).alias("duration_sec"), _gib(F.col("read_bytes"), 3).alias("gb_scanned"),
        F.col("start_time").alias("started_at"), "total_duration_ms", "read_bytes", *extra,
    ]


def _priced_statements(ctx: Ctx, best: DataFrame) -> DataFrame:
    """A few chosen statements with workspace and cost share of their warehouse."""
    rows = best.join(_warehouse_costs(ctx), "warehouse_id", "left").withColumn(
        "estimated_cost", rnd(F.coalesce(_share("duration_sec", 1000), F.lit(0.0)), 2)
    )
    rows = rows.join(warehouse_workspace(ctx), "warehouse_id", "left")
    return with_workspace(ctx, rows, "workspace_name").drop("cost_90d", "total_ms", "total_duration_ms", "read_bytes")


def _share(duration: str, to_ms: int) -> Column:
    """This statement's part of its warehouse's 90-day cost."""
    ms = F.col(duration).cast("double") * to_ms
    return F.try_divide(ms, F.col("total_ms")) * F.col("cost_90d")


def _warehouse_costs(ctx: Ctx) -> DataFrame:
    ms = warehouse_total_duration(ctx).select("warehouse_id", F.col("total_ms_90d").alias("total_ms"))
    return ms.join(warehouse_spend(ctx).select("warehouse_id", "cost_90d"), "warehouse_id", "left")


@report("top_expensive_queries")
def top_expensive_queries(ctx: Ctx, n: int | None = 50) -> DataFrame:
    rows = _history(ctx).where(F.col("read_bytes") > 0).select(
        *_statement(rnd(F.col("read_rows").cast("double") / 1_000_000, 2).alias("m_rows_read"))
    )
    return _priced_statements(ctx, top(rows, n, desc("read_bytes"))).orderBy(desc("gb_scanned"))


def _slow(ctx: Ctx) -> DataFrame:
    return _history(ctx).where(F.col("total_duration_ms") > 60_000)


@report("slow_queries")
def slow_queries(ctx: Ctx, n: int | None = 50) -> DataFrame:
    rows = _slow(ctx).select(*_statement())
    return _priced_statements(ctx, top(rows, n, desc("total_duration_ms"))).orderBy(desc("duration_sec"))


@report("query_cost_estimate")
def query_cost_estimate(ctx: Ctx) -> DataFrame:
    """Cost share of every statement of the window that ran on a warehouse with cost."""
    rows = _history(ctx).select("statement_id", F.col(WAREHOUSE).alias("warehouse_id"), "total_duration_ms")
    return rows.join(_warehouse_costs(ctx), "warehouse_id").select(
        "statement_id", "warehouse_id", rnd(F.coalesce(_share("total_duration_ms", 1), F.lit(0.0)), 4).alias("estimated_cost")
    )


@report("query_warehouse_stats")
def query_warehouse_stats(ctx: Ctx) -> DataFrame:
    """Query volume per warehouse with its spend."""
    rows = _history(ctx).where(F.col(WAREHOUSE).isNotNull()).groupBy(F.col(WAREHOUSE).alias("warehouse_id")).agg(
        *_volume(ctx), F.count_distinct("executed_by").alias("unique_users")
    )
    spend = warehouse_spend(ctx)
    measures = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in spend.columns if c != "warehouse_id"}
    return rows.join(spend, "warehouse_id", "left").withColumns(measures).orderBy(desc("gb_90d"))


@report("warehouse_spend_306090")
def warehouse_spend(ctx: Ctx) -> DataFrame:
    wh = F.col("usage_metadata.warehouse_id")
    return priced_usage(ctx, 90).where(wh.isNotNull()).groupBy(wh.alias("warehouse_id")).agg(*spend_windows(ctx))


def _durations(ctx: Ctx, prefix: str) -> list[Column]:
    ms = F.col("total_duration_ms")
    return [
        F.coalesce(F.sum(ms if d == 90 else F.when(_since(ctx, d), ms)), F.lit(0)).alias(f"{prefix}_{d}d")
        for d in (30, 60, 90)
    ]


@report("user_warehouse_duration")
def user_warehouse_duration(ctx: Ctx) -> DataFrame:
    rows = _history(ctx).where(C.is_interactive_query() & F.col(WAREHOUSE).isNotNull())
    return rows.groupBy(F.col("executed_by").alias("user_email"), F.col(WAREHOUSE).alias("warehouse_id")).agg(
        *_durations(ctx, "user_ms")
    )


@report("warehouse_total_duration")
def warehouse_total_duration(ctx: Ctx) -> DataFrame:
    """All statements, interactive or not."""
    return _history(ctx).where(F.col(WAREHOUSE).isNotNull()).groupBy(F.col(WAREHOUSE).alias("warehouse_id")).agg(
        *_durations(ctx, "total_ms")
    )


def _attributed(ctx: Ctx) -> DataFrame:
    """user x warehouse with the user's part of the warehouse cost per window, unrounded."""
    rows = (
        user_warehouse_duration(ctx).join(warehouse_total_duration(ctx), "warehouse_id")
        .join(warehouse_spend(ctx), "warehouse_id", "left")
    )
    return rows.withColumns({
        f"share_{d}d": F.coalesce(
            F.try_divide(F.col(f"user_ms_{d}d").cast("double"), F.col(f"total_ms_{d}d")) * F.col(f"cost_{d}d"), F.lit(0.0)
        ) for d in (30, 60, 90)
    })


@report("join_attribution")
def join_attribution(ctx: Ctx) -> DataFrame:
    return _attributed(ctx).select("user_email", "warehouse_id", rnd("share_90d", 4).alias("cost_90d"))


@report("user_cost_attribution")
def user_cost_attribution(ctx: Ctx) -> DataFrame:
    return _attributed(ctx).groupBy("user_email").agg(
        *[rnd(F.sum(f"share_{d}d"), 2).alias(f"cost_{d}d") for d in (30, 60, 90)]
    ).orderBy(desc("cost_90d"))


@report("warehouse_events")
def warehouse_events(ctx: Ctx, n: int | None = None) -> DataFrame:
    rows = ctx.recent_ts("compute.warehouse_events", "event_time", 7).select(
        "warehouse_id", "event_time", "event_type", "cluster_count"
    )
    best = top(rows, n, desc("event_time"))
    return with_workspace(ctx, best.join(warehouse_workspace(ctx), "warehouse_id", "left"), "workspace_name")


@report("query_summary")
def query_summary(ctx: Ctx) -> DataFrame:
    """Totals over all interactive users; slow statements are counted whoever ran them."""
    slow = _slow(ctx).agg(F.count("*").alias("n")).scalar()
    return _user_stats(ctx).agg(
        F.coalesce(F.sum("queries_90d"), F.lit(0)).alias("total_queries"),
        rnd(F.coalesce(F.sum("gb_90d"), F.lit(0.0)), 2).alias("total_gb_scanned"), F.count("*").alias("unique_users"),
        F.coalesce(F.sum("failed_count"), F.lit(0)).alias("total_failed"),
    ).withColumn("slow_queries", slow)
