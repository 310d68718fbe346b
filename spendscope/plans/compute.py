"""Compute right-sizing: latest configurations, spend windows, utilisation, warning flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendscope.context import Ctx
from spendscope.functions.measures import desc, rnd, top, total, total_if
from spendscope.operators.pricing import priced_usage
from spendscope.operators.versions import latest_version
from spendscope.plans.cost import with_workspace
from spendscope.plans.registry import report

WINDOWS = (30, 60, 90)
LARGE_MIN_WORKERS = 8
SPEND_COLUMNS = [f"{m}_{d}d" for d in WINDOWS for m in ("units", "cost")] + ["active_days"]


def spend_windows(ctx: Ctx, places: int = 2) -> list[Column]:
    """Units and cost of the last 30, 60 and 90 days, as conditional sums of one 90-day scan."""
    out = []
    for d in WINDOWS:
        inside = F.col("usage_date") >= F.lit(ctx.back(d))
        out += [
            total_if(inside, "usage_quantity", places).alias(f"units_{d}d"),
            total_if(inside, "cost", places).alias(f"cost_{d}d"),
        ]
    return out


def _active_days() -> Column:
    return F.count_distinct("usage_date").alias("active_days")


def _resource() -> Column:
    return F.coalesce("usage_metadata.cluster_id", "usage_metadata.warehouse_id")


@report("clusters_latest")
def clusters_latest(ctx: Ctx) -> DataFrame:
    """Newest interactive configuration of each cluster whose newest version is not a deletion.

    Job clusters and pipeline execution clusters are left out before ranking; deletion is decided on
    the newest version of any kind.
    """
    source, name = F.col("cluster_source"), F.col("cluster_name")
    versions = ctx.table("compute.clusters")
    interactive = versions.where(
        (source.isNull() | (source != "JOB")) & ~F.coalesce(name, F.lit("")).startswith("dlt-execution-")
    )
    newest = latest_version(interactive, ["cluster_id"], drop_deleted=False)
    return newest.join(deleted_clusters(ctx), "cluster_id", "left_anti").withColumnsRenamed(
        {"owned_by": "owner", "change_time": "last_modified"}
    )


def deleted_clusters(ctx: Ctx) -> DataFrame:
    newest = latest_version(ctx.table("compute.clusters"), ["cluster_id"], drop_deleted=False)
    return newest.where(F.col("delete_time").isNotNull()).select("cluster_id")


@report("anti_deleted")
def anti_deleted(ctx: Ctx) -> DataFrame:
    """Clusters that were seen at any time and are not deleted."""
    seen = ctx.table("compute.clusters").select("cluster_id").distinct()
    return seen.join(deleted_clusters(ctx), "cluster_id", "left_anti")


@report("warehouses_latest")
def warehouses_latest(ctx: Ctx) -> DataFrame:
    newest = latest_version(ctx.table("compute.warehouses"), ["warehouse_id"])
    return newest.drop("delete_time").withColumnRenamed("change_time", "last_modified")


@report("warehouse_workspace")
def warehouse_workspace(ctx: Ctx) -> DataFrame:
    newest = latest_version(ctx.table("compute.warehouses"), ["warehouse_id"], drop_deleted=False)
    return newest.select("warehouse_id", "workspace_id")


def _billed_pipelines(ctx: Ctx) -> DataFrame:
    pipeline = F.col("usage_metadata.dlt_pipeline_id")
    return ctx.recent("billing.usage", "usage_date", 90).where(pipeline.isNotNull()).select(
        pipeline.alias("pipeline_id"), "workspace_id"
    ).distinct()


@report("pipeline_spend_306090")
def pipeline_spend(ctx: Ctx) -> DataFrame:
    pipeline = F.col("usage_metadata.dlt_pipeline_id")
    return priced_usage(ctx, 90).where(pipeline.isNotNull()).groupBy(
        pipeline.alias("pipeline_id"), "workspace_id"
    ).agg(*spend_windows(ctx), _active_days())


@report("recent_active_ids")
def recent_active_ids(ctx: Ctx) -> DataFrame:
    return ctx.recent("billing.usage", "usage_date", 30).where(_resource().isNotNull()).select(
        _resource().alias("resource_id")
    ).distinct()


@report("resource_spend_306090")
def resource_spend(ctx: Ctx) -> DataFrame:
    counts = [
        F.count_if(F.col("usage_date") >= F.lit(ctx.back(d))).alias(f"rows_{d}d") for d in WINDOWS
    ]
    return priced_usage(ctx, 90).where(_resource().isNotNull()).groupBy(_resource().alias("resource_id")).agg(
        *spend_windows(ctx), *counts, _active_days()
    )


def _task_utilisation(ctx: Ctx) -> DataFrame:
    slots = F.col("num_task_slots")
    busy = F.when(slots > 0, F.col("avg_num_running_tasks").cast("double") / slots * 100).otherwise(0.0)
    driver = F.coalesce("is_driver", F.lit(False))
    return ctx.recent_ts("compute.node_timeline", "start_time", 7).groupBy("cluster_id", "workspace_id").agg(
        F.count_distinct("node_id").alias("node_count"),
        rnd(F.sum("uptime_seconds") / 3600, 1).alias("total_node_hours"),
        rnd(F.avg(busy), 1).alias("avg_task_util_pct"),
        rnd(F.max(busy), 1).alias("peak_task_util_pct"),
        rnd(F.avg(F.col("avg_num_queued_tasks").cast("double")), 2).alias("avg_queued_tasks"),
        F.count_if(driver).alias("driver_samples"),
        F.count_if(~driver).alias("worker_samples"),
    )


@report("node_task_utilisation")
def node_task_utilisation(ctx: Ctx, n: int | None = None) -> DataFrame:
    return top(_task_utilisation(ctx), n, desc("total_node_hours"))


@report("node_types")
def node_types(ctx: Ctx, n: int | None = None) -> DataFrame:
    return top(_hardware(ctx), n, desc("memory_mb"))


def _hardware(ctx: Ctx) -> DataFrame:
    return ctx.table("compute.node_types").select(
        "node_type_id", "num_cpus", "memory_mb", rnd(F.col("memory_mb") / 1024, 1).alias("memory_gb"),
        F.coalesce("num_gpus", F.lit(0)).alias("num_gpus"), F.coalesce("gpu_name", F.lit("")).alias("gpu_name"),
        "is_deprecated", "category",
    )


def _flags(**conditions: Column) -> Column:
    """Names of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]))


def _with_spend(ctx: Ctx, df: DataFrame, key: str) -> DataFrame:
    spend = resource_spend(ctx).select(F.col("resource_id").alias(key), *SPEND_COLUMNS)
    return df.join(spend, key, "left").withColumns({
        c: F.coalesce(F.col(c), F.lit(0).cast("bigint" if c == "active_days" else "double")) for c in SPEND_COLUMNS
    })


def _sized_clusters(ctx: Ctx) -> DataFrame:
    low, high = F.coalesce("min_autoscale_workers", F.lit(0)), F.coalesce("max_autoscale_workers", F.lit(0))
    idle, gone = F.coalesce("auto_termination_minutes", F.lit(0)), F.col("delete_time").isNotNull()
    flags = _flags(
        terminated=gone, no_auto_terminate=~gone & (idle == 0), fixed_size=~gone & (low == high) & (high > 0),
        large_min_workers=~gone & (low >= LARGE_MIN_WORKERS),
    )
    return clusters_latest(ctx).withColumns({
        "min_workers": low, "max_workers": high, "auto_terminate_minutes": idle, "flags": flags,
        "runtime_version": F.coalesce("runtime_version", F.lit("unknown")),
    }).drop("min_autoscale_workers", "max_autoscale_workers", "auto_termination_minutes")


def _with_hardware(ctx: Ctx, df: DataFrame) -> DataFrame:
    for role in ("driver", "worker"):
        hw = _hardware(ctx).select(
            F.col("node_type_id").alias(f"{role}_node_type"), F.col("num_cpus").alias(f"{role}_cpus"),
            F.col("memory_gb").alias(f"{role}_mem_gb"), F.nullif("num_gpus", F.lit(0)).alias(f"{role}_gpus"),
        )
        df = df.join(hw, f"{role}_node_type", "left")
    return df.drop("driver_gpus")


@report("join_enrich_compute")
def join_enrich_compute(ctx: Ctx) -> DataFrame:
    """Clusters with workspace, hardware and spend attached."""
    rows = _with_hardware(ctx, with_workspace(ctx, clusters_latest(ctx), "workspace_name", "resource_group"))
    return _with_spend(ctx, rows, "cluster_id").select(
        "cluster_id", "workspace_name", "resource_group", "driver_cpus", "driver_mem_gb", "worker_cpus",
        "worker_mem_gb", "worker_gpus", "cost_30d", "cost_90d", "active_days",
    )


def _cluster_sizing(ctx: Ctx) -> DataFrame:
    util = _task_utilisation(ctx).select(
        "cluster_id", "workspace_id", "node_count", "total_node_hours", "avg_task_util_pct",
        "peak_task_util_pct", "avg_queued_tasks",
    )
    # One row per cluster: a cluster sampled under several workspaces keeps the busiest one.
    util = util.groupBy("cluster_id").agg(
        F.max_by(F.struct(*[c for c in util.columns if c not in ("cluster_id", "workspace_id")]),
                 F.struct("total_node_hours", "workspace_id")).alias("_u")
    ).select("cluster_id", "_u.*")
    rows = with_workspace(ctx, _sized_clusters(ctx), "workspace_name", "subscription_id", "resource_group")
    return _with_hardware(ctx, _with_spend(ctx, rows, "cluster_id").join(util, "cluster_id", "left"))


@report("cluster_sizing")
def cluster_sizing(ctx: Ctx) -> DataFrame:
    """Warning flags first, then by 90-day cost; terminated clusters last."""
    gone = F.array_contains("flags", "terminated")
    return _cluster_sizing(ctx).orderBy(gone, F.size("flags").desc(), desc("cost_90d")).withColumn(
        "flags", F.array_join("flags", ",")
    )


def _flagged_warehouses(ctx: Ctx) -> DataFrame:
    flags = _flags(
        no_auto_stop=F.coalesce("auto_stop_minutes", F.lit(0)) == 0,
        min_clusters_gt_1=F.coalesce("min_clusters", F.lit(0)) > 1,
    )
    return warehouses_latest(ctx).withColumn("flags", flags)


def _warehouse_sizing(ctx: Ctx) -> DataFrame:
    rows = _flagged_warehouses(ctx)
    return _with_spend(ctx, with_workspace(ctx, rows, "workspace_name", "subscription_id", "resource_group"), "warehouse_id")


@report("warehouse_sizing")
def warehouse_sizing(ctx: Ctx) -> DataFrame:
    return _warehouse_sizing(ctx).orderBy(F.size("flags").desc(), desc("cost_90d")).withColumn(
        "flags", F.array_join("flags", ",")
    )


@report("runtime_versions")
def runtime_versions(ctx: Ctx) -> DataFrame:
    return clusters_latest(ctx).groupBy(F.coalesce("runtime_version", F.lit("unknown")).alias("version")).agg(
        F.count("*").alias("cluster_count")
    ).orderBy(desc("cluster_count"))


@report("warehouse_sizes")
def warehouse_sizes(ctx: Ctx) -> DataFrame:
    return warehouses_latest(ctx).groupBy(F.coalesce("warehouse_size", F.lit("unknown")).alias("size")).agg(
        F.count("*").alias("warehouse_count")
    ).orderBy(desc("warehouse_count"))


# How a pipeline's trigger setting is shown, and whether it counts as one.
TRIGGERS = {
    "CONTINUOUS": ("Continuous", True), "CRON": ("Cron", True), "FILE_ARRIVAL": ("File Arrival", True),
    "SCHEDULED": ("Scheduled", True), "MANUAL": ("Manual", False),
}


def pipeline_settings(ctx: Ctx) -> DataFrame:
    """Latest settings per pipeline; a pipeline without a trigger setting has type None."""
    newest = latest_version(ctx.table("lakeflow.pipelines"), ["workspace_id", "pipeline_id"])
    label, has = F, F
    for code, (name, triggers) in TRIGGERS.items():
        label = label.when(F.col("trigger_kind") == code, name)
        has = has.when(F.col("trigger_kind") == code, F.lit(triggers))
    return newest.groupBy("pipeline_id").agg(
        F.max_by(F.struct(F.col("name"), label.otherwise("None").alias("trigger_type"),
                          has.otherwise(F.lit(False)).alias("has_trigger")),
                 F.struct("change_time", "workspace_id")).alias("_s")
    ).select("pipeline_id", "_s.*")


@report("pipeline_sizing")
def pipeline_sizing(ctx: Ctx) -> DataFrame:
    """Pipeline spend with trigger settings; NULL ``has_trigger`` marks pipelines without settings."""
    rows = pipeline_spend(ctx).join(pipeline_settings(ctx), "pipeline_id", "left").withColumns({
        "name": F.coalesce("name", F.concat(F.substring("pipeline_id", 1, 20), F.lit("…"))),
        "trigger_type": F.coalesce("trigger_type", F.lit("Unknown")),
    })
    return with_workspace(ctx, rows, "workspace_name", "subscription_id", "resource_group").orderBy(desc("cost_90d"))


@report("join_pipeline_info")
def join_pipeline_info(ctx: Ctx) -> DataFrame:
    return pipeline_sizing(ctx).groupBy("trigger_type", "has_trigger").agg(
        F.count("*").alias("pipelines"), rnd(F.sum("cost_90d"), 2).alias("cost_90d")
    )


@report("compute_summary")
def compute_summary(ctx: Ctx) -> DataFrame:
    """Counts of each flag. ``underutilised``: below 20 % task use with 30-day cost over 10."""
    def flagged(name: str) -> Column:
        return F.count_if(F.array_contains("flags", name))

    clusters = _cluster_sizing(ctx).agg(
        F.count("*").alias("total_clusters"), flagged("no_auto_terminate").alias("no_auto_terminate"),
        flagged("fixed_size").alias("no_autoscale"), flagged("large_min_workers").alias("oversized_clusters"),
        F.count_distinct("runtime_version").alias("runtime_versions_in_use"),
        F.count_if((F.col("avg_task_util_pct") < 20) & (F.col("cost_30d") > 10)).alias("underutilised"),
    )
    warehouses = _flagged_warehouses(ctx).agg(F.count("*").alias("total_warehouses"), flagged("no_auto_stop").alias("no_auto_stop"))
    settings = pipeline_settings(ctx).groupBy("pipeline_id").agg(F.count_if(~F.col("has_trigger")).alias("_none"))
    pipelines = _billed_pipelines(ctx).join(settings, "pipeline_id", "left").agg(
        F.count("*").alias("total_pipelines"), F.coalesce(F.sum("_none"), F.lit(0)).alias("pipelines_no_trigger")
    )
    # One row a part, put together by a sum: each part is evaluated once.
    rows = clusters.unionByName(warehouses, allowMissingColumns=True).unionByName(pipelines, allowMissingColumns=True)
    return rows.agg(*(F.sum(c).alias(c) for c in rows.columns))
