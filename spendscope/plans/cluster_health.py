"""Cluster events and node utilisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendscope.context import Ctx
from spendscope.functions.measures import desc, rnd, top
from spendscope.plans.registry import report

EVENTS, NODES = "compute.cluster_events", "compute.node_timeline"
LOOKBACK, NODE_LOOKBACK = 30, 7

# Event types by meaning.
FAILURE_TYPES = ("FAILED", "ERROR", "DRIVER_NOT_FOUND", "DRIVER_UNAVAILABLE", "SPARK_ERROR")
SCALE_TYPES = ("RESIZING", "UPSIZE_COMPLETED", "NODES_LOST", "AUTOSCALING_STATS_REPORT")


def _events(ctx: Ctx) -> DataFrame:
    return ctx.recent_ts(EVENTS, "event_time", LOOKBACK).select(
        "event_time", "cluster_id", "event_type", "workspace_id", "event_ref"
    )


@report("cluster_events")
def cluster_events(ctx: Ctx, n: int | None = None) -> DataFrame:
    """The latest events; the counts below are over all events of the window."""
    return top(_events(ctx), n, desc("event_time"))


@report("cluster_event_summary")
def cluster_event_summary(ctx: Ctx) -> DataFrame:
    rows = _events(ctx).groupBy("cluster_id", "event_type").agg(
        F.count("*").alias("event_count"), F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen")
    )
    return rows.orderBy(desc("event_count"))


def _node_days(ctx: Ctx) -> DataFrame:
    """Samples summed per node and day, from which both reports below are cut."""
    cpu = F.col("cpu_user_percent") + F.col("cpu_system_percent")
    mem = F.col("mem_used_percent")
    return ctx.recent_ts(NODES, "start_time", NODE_LOOKBACK).groupBy(
        "cluster_id", F.col("is_driver").alias("driver"), F.to_date("start_time").alias("day"), "node_id"
    ).agg(
        F.sum(cpu).alias("_cpu"), F.max(cpu).alias("_max_cpu"), F.sum(mem).alias("_mem"), F.max(mem).alias("_max_mem"),
        F.count("*").alias("_n"),
    )


def _utilisation() -> list[Column]:
    def mean(c: str) -> Column:
        return rnd(F.sum(c).cast("double") / F.sum("_n"), 1)

    return [
        mean("_cpu").alias("avg_cpu_pct"), rnd(F.max("_max_cpu"), 1).alias("peak_cpu_pct"),
        mean("_mem").alias("avg_mem_pct"), rnd(F.max("_max_mem"), 1).alias("peak_mem_pct"),
        F.count_distinct("node_id").alias("node_count"),
    ]


@report("node_utilisation_daily")
def node_utilisation_daily(ctx: Ctx) -> DataFrame:
    rows = _node_days(ctx).groupBy("cluster_id", "driver", "day").agg(*_utilisation())
    return rows.orderBy(desc("day"), "cluster_id")


def _cluster_utilisation(ctx: Ctx) -> DataFrame:
    return _node_days(ctx).groupBy("cluster_id").agg(*_utilisation(), F.count_distinct("day").alias("active_days"))


@report("cluster_utilisation")
def cluster_utilisation(ctx: Ctx, n: int | None = None) -> DataFrame:
    return top(_cluster_utilisation(ctx), n, desc("avg_cpu_pct"))


def _of_types(df: DataFrame, types: tuple[str, ...]) -> DataFrame:
    return df.where(F.upper("event_type").isin(*types))


@report("failure_events")
def failure_events(ctx: Ctx, n: int | None = None) -> DataFrame:
    return top(_of_types(_events(ctx), FAILURE_TYPES), n, desc("event_time"))


@report("scale_events")
def scale_events(ctx: Ctx, n: int | None = None) -> DataFrame:
    return top(_of_types(_events(ctx), SCALE_TYPES), n, desc("event_time"))


@report("cluster_event_types")
def cluster_event_types(ctx: Ctx) -> DataFrame:
    return _events(ctx).groupBy("event_type").agg(F.count("*").alias("event_count")).orderBy(desc("event_count"))


@report("cluster_event_daily")
def cluster_event_daily(ctx: Ctx) -> DataFrame:
    return _events(ctx).groupBy(F.to_date("event_time").alias("day")).agg(F.count("*").alias("event_count")).orderBy("day")


@report("busiest_clusters")
def busiest_clusters(ctx: Ctx, n: int | None = 50) -> DataFrame:
    return top(_events(ctx).groupBy("cluster_id").agg(F.count("*").alias("total_events")), n, desc("total_events"))


@report("health_summary")
def health_summary(ctx: Ctx) -> DataFrame:
    kind, busy = F.upper("event_type"), _cluster_utilisation(ctx)
    return _events(ctx).agg(
        F.count("*").alias("total_events"), F.count_distinct("cluster_id").alias("unique_clusters"),
        F.count_if(kind.isin(*FAILURE_TYPES)).alias("failure_events"), F.count_if(kind.isin(*SCALE_TYPES)).alias("scale_events"),
    ).withColumns({
        "high_cpu_clusters": busy.agg(F.count_if(F.col("avg_cpu_pct") > 70).alias("n")).scalar(),
        "high_mem_clusters": busy.agg(F.count_if(F.col("avg_mem_pct") > 80).alias("n")).scalar(),
    })
