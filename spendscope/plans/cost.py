"""Cost and usage breakdowns over a filtered period, a one-day drill-down, tags and filter options."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendscope.context import Ctx
from spendscope.functions import classify as C
from spendscope.functions.measures import desc, rnd, top, total
from spendscope.operators.filters import UsageFilter, filter_usage, scope_workspaces
from spendscope.operators.pricing import priced_usage
from spendscope.operators.sessions import last_sessions
from spendscope.operators.versions import latest_version
from spendscope.plans.registry import report

TEAM_TAG = "Team"
LOOKBACK_TAGS = 90
ID_FIELDS = (
    "cluster_id", "warehouse_id", "job_id", "job_run_id", "dlt_pipeline_id", "notebook_id",
    "endpoint_name", "endpoint_id",
)


def _period(ctx: Ctx, p: UsageFilter | None) -> DataFrame:
    return priced_usage(ctx, usage=filter_usage(ctx, p or UsageFilter()))


def _units(places: int = 2) -> Column:
    return total("usage_quantity", places).alias("units")


def _cost(places: int = 2) -> Column:
    return total("cost", places).alias("cost")


def workspace_names(ctx: Ctx) -> DataFrame:
    return ctx.table("access.workspaces_latest").select(
        "workspace_id", "workspace_name", "workspace_url", "subscription_id", "resource_group"
    )


def with_workspace(ctx: Ctx, df: DataFrame, *columns: str) -> DataFrame:
    """Left join of workspace attributes."""
    return df.join(workspace_names(ctx).select("workspace_id", *columns), "workspace_id", "left")


@report("cost_summary")
def cost_summary(ctx: Ctx, p: UsageFilter | None = None) -> DataFrame:
    """Summed per workspace and SKU first, so the distinct counts see only those few rows."""
    pairs = _period(ctx, p).groupBy("workspace_id", "sku_name").agg(
        F.sum("usage_quantity").alias("usage_quantity"), F.sum("cost").alias("cost")
    )
    return pairs.agg(
        F.count_distinct("workspace_id").alias("workspace_count"),
        F.count_distinct("sku_name").alias("product_count"),
        F.coalesce(total("usage_quantity"), F.lit(0.0)).alias("units"),
        F.coalesce(total("cost"), F.lit(0.0)).alias("cost"),
    )


@report("cost_daily_trend")
def cost_daily_trend(ctx: Ctx, p: UsageFilter | None = None) -> DataFrame:
    return (
        _period(ctx, p)
        .groupBy("usage_date", C.product_category(F.col("sku_name")).alias("product_category"))
        .agg(_units(4), _cost())
        .orderBy("usage_date", "product_category")
    )


@report("cost_by_product")
def cost_by_product(ctx: Ctx, p: UsageFilter | None = None) -> DataFrame:
    return (
        _period(ctx, p)
        .groupBy("sku_name", C.product_category(F.col("sku_name")).alias("product_category"))
        .agg(_units(), _cost(), F.count_distinct("workspace_id").alias("workspace_count"))
        .orderBy(desc("units"), "sku_name")
    )


@report("cost_by_workspace")
def cost_by_workspace(ctx: Ctx, p: UsageFilter | None = None, n: int | None = 20) -> DataFrame:
    by_ws = _period(ctx, p).groupBy("workspace_id").agg(
        _units(), _cost(), F.count_distinct("sku_name").alias("product_count")
    )
    return top(by_ws, n, desc("units"))


# ---- one-day drill-down ----


def _day_usage(ctx: Ctx, day: dt.date | None) -> DataFrame:
    day = day or ctx.day()
    usage = ctx.table("billing.usage").where(F.col("usage_date") == F.lit(day))
    return priced_usage(ctx, usage=scope_workspaces(ctx, usage))


def _by_resource(day_usage: DataFrame) -> DataFrame:
    """Per workspace, resource and SKU, with one representative (least) value of each related id."""
    ids = [F.min(f"usage_metadata.{i}").alias(i) for i in ID_FIELDS]
    return day_usage.groupBy("workspace_id", C.resource_id().alias("resource_id"), "sku_name").agg(
        *ids, F.min("identity_metadata.run_as").alias("run_as"), _units(), _cost()
    )


def _with_path(df: DataFrame) -> DataFrame:
    product = C.product_category_fine(F.col("sku_name"))
    return df.withColumn("product", product).withColumn("ui_path", C.resource_path(F.col("product")))


@report("spike_by_workspace")
def spike_by_workspace(ctx: Ctx, day: dt.date | None = None) -> DataFrame:
    by_ws = _day_usage(ctx, day).groupBy("workspace_id").agg(
        _units(), _cost(), F.count_distinct("sku_name").alias("sku_count")
    )
    return with_workspace(ctx, by_ws, "workspace_name", "workspace_url").orderBy(desc("cost"), "workspace_id")


@report("spike_resources")
def spike_resources(ctx: Ctx, day: dt.date | None = None, per_workspace: int = 20) -> DataFrame:
    """The costliest resources of each workspace that day."""
    rows = _by_resource(_day_usage(ctx, day).where(C.resource_id().isNotNull()))
    best = Window.partitionBy("workspace_id").orderBy(desc("cost"), F.asc("resource_id"), F.asc("sku_name"))
    ranked = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= per_workspace)
    return _with_path(ranked)


@report("spike_by_product")
def spike_by_product(ctx: Ctx, day: dt.date | None = None) -> DataFrame:
    rows = (
        _day_usage(ctx, day)
        .groupBy("sku_name", C.product_category(F.col("sku_name")).alias("product_category"), "workspace_id")
        .agg(_units(), _cost())
    )
    return with_workspace(ctx, rows, "workspace_name", "resource_group").orderBy(
        desc("cost"), "sku_name", "workspace_id"
    )


@report("spike_top_resources")
def spike_top_resources(ctx: Ctx, day: dt.date | None = None, n: int | None = 30) -> DataFrame:
    """Top 30; usage without any resource id forms one row per SKU and workspace."""
    best = top(_by_resource(_day_usage(ctx, day)), n, desc("cost"))
    return with_workspace(ctx, _with_path(best), "workspace_name", "resource_group").orderBy(desc("cost"))


def _with_job_name(ctx: Ctx, df: DataFrame) -> DataFrame:
    jobs = latest_version(ctx.table("lakeflow.jobs"), ["workspace_id", "job_id"]).select(
        "workspace_id", "job_id", F.col("name").alias("job_name")
    )
    return df.join(jobs, ["workspace_id", "job_id"], "left")


def _job_rows(usage: DataFrame) -> DataFrame:
    job = F.col("usage_metadata.job_id")
    return usage.withColumn("job_id", job).where(job.isNotNull())


@report("spike_by_job")
def spike_by_job(ctx: Ctx, day: dt.date | None = None, n: int | None = None) -> DataFrame:
    """Top 100 job x workspace x SKU. The run ids themselves are the rows of ``spike_job_runs``."""
    rows = _job_rows(_day_usage(ctx, day)).groupBy("job_id", "workspace_id", "sku_name").agg(
        F.count_distinct("usage_metadata.job_run_id").alias("run_count"), _units(), _cost()
    )
    named = with_workspace(ctx, _with_job_name(ctx, top(rows, n, desc("cost"))), "workspace_name")
    return named.orderBy(desc("cost"), "job_id")


@report("spike_job_runs")
def spike_job_runs(ctx: Ctx, day: dt.date | None = None, n: int | None = None) -> DataFrame:
    """One row per run of the jobs in ``spike_by_job``, so a job's run list never sits in one value."""
    usage = _job_rows(_day_usage(ctx, day))
    keys = ["job_id", "workspace_id", "sku_name"]
    best = top(usage.groupBy(*keys).agg(_cost()), n, desc("cost")).select(*keys)
    run = F.col("usage_metadata.job_run_id").alias("run_id")
    return usage.join(best, keys, "left_semi").groupBy(*keys, run).agg(_units(), _cost())


@report("spike_totals")
def spike_totals(ctx: Ctx, day: dt.date | None = None) -> DataFrame:
    return spike_by_workspace(ctx, day).agg(
        F.coalesce(total("cost"), F.lit(0.0)).alias("cost"),
        F.coalesce(total("units"), F.lit(0.0)).alias("units"),
        F.count("*").alias("workspaces"),
    )


# ---- tags and filter options ----


@report("cost_by_tag")
def cost_by_tag(ctx: Ctx, tag: str = TEAM_TAG, p: UsageFilter | None = None, n: int | None = 20) -> DataFrame:
    value = F.col("custom_tags")[tag]
    rows = _period(ctx, p).where(value.isNotNull()).groupBy(value.alias("tag_value")).agg(
        _units(), _cost(), F.count_distinct("workspace_id").alias("workspace_count")
    )
    return top(rows, n, desc("units"))


@report("cost_by_tag_env")
def cost_by_tag_env(ctx: Ctx, tag: str = TEAM_TAG, p: UsageFilter | None = None, n: int | None = None) -> DataFrame:
    """Summed per workspace before the workspace's name is looked up, then per environment."""
    value = F.col("custom_tags")[tag]
    by_ws = _period(ctx, p).where(value.isNotNull()).groupBy(value.alias("tag_value"), "workspace_id").agg(
        F.sum("usage_quantity").alias("usage_quantity"), F.sum("cost").alias("cost")
    )
    env = C.env_from_workspace(F.col("workspace_name")).alias("environment")
    rows = with_workspace(ctx, by_ws, "workspace_name").groupBy("tag_value", env).agg(_units(), _cost())
    return top(rows, n, desc("units"))


def _recent_usage(ctx: Ctx) -> DataFrame:
    return scope_workspaces(ctx, ctx.recent("billing.usage", "usage_date", LOOKBACK_TAGS))


@report("tag_values")
def tag_values(ctx: Ctx, tag: str = TEAM_TAG) -> DataFrame:
    value = F.col("custom_tags")[tag]
    return (
        _recent_usage(ctx).where(value.isNotNull() & (value != "")).select(value.alias("tag_value")).distinct()
    )


@report("tag_keys")
def tag_keys(ctx: Ctx) -> DataFrame:
    entry = F.explode("custom_tags").alias("tag_key", "tag_value")
    return (
        _recent_usage(ctx).select(entry).where(F.col("tag_value").isNotNull()).select("tag_key").distinct()
        .orderBy("tag_key")
    )


@report("filter_options")
def filter_options(ctx: Ctx) -> DataFrame:
    """Choices for the filter boxes, of workspaces with usage in the last 90 days: kind, id, name.

    Subscriptions that have a display name are offered whether used or not.
    """
    active = _recent_usage(ctx).select("workspace_id").distinct()
    dim = active.join(workspace_names(ctx), "workspace_id", "left")

    def options(kind: str, ident: Column, name: Column) -> DataFrame:
        return dim.where(ident.isNotNull() & (ident != "")).select(
            F.lit(kind).alias("kind"), ident.alias("id"), name.alias("name")
        ).distinct()

    ws, sub, rg = F.col("workspace_id"), F.col("subscription_id"), F.col("resource_group")
    named = F.coalesce(F.nullif(F.col("workspace_name"), F.lit("")), ws)
    subscriptions = options("subscription", sub, C.subscription_name(sub, ctx.subscription_names))
    if ctx.subscription_names:
        listed = F.explode(F.create_map(*[F.lit(x) for pair in ctx.subscription_names.items() for x in pair])).alias("id", "name")
        named_ones = ctx.spark.range(1).select(F.lit("subscription").alias("kind"), listed)
        used = subscriptions.select(F.lower("id").alias("_used"))
        unused = named_ones.join(used, F.lower("id") == F.col("_used"), "left_anti")
        subscriptions = subscriptions.unionByName(unused)
    return options("workspace", ws, named).unionByName(subscriptions).unionByName(options("resource_group", rg, rg))


@report("resource_groups")
def resource_groups(ctx: Ctx, subscriptions: tuple[str, ...] = ("SUB-1", "sub-2")) -> DataFrame:
    dim = scope_workspaces(ctx, workspace_names(ctx))
    if subscriptions:
        dim = dim.where(F.lower("subscription_id").isin(*[s.lower() for s in subscriptions]))
    return (
        dim.where(F.col("resource_group") != "").select("resource_group").distinct()
        .orderBy(F.lower("resource_group"), "resource_group")
    )


# ---- snapshot, sessions, jobs ----


@report("billing_snapshot")
def billing_snapshot(ctx: Ctx) -> DataFrame:
    """Yesterday and today per cluster, warehouse, job run and pipeline, in one pass over usage."""
    kinds = {"cluster": "cluster_id", "warehouse": "warehouse_id", "run": "job_run_id", "pipeline": "dlt_pipeline_id"}
    ids = F.explode(F.array(*[
        F.struct(F.lit(k).alias("type"), F.nullif(F.col(f"usage_metadata.{c}"), F.lit("")).alias("id"))
        for k, c in kinds.items()
    ])).alias("r")
    usage = scope_workspaces(ctx, ctx.recent("billing.usage", "usage_date", 1))
    return (
        priced_usage(ctx, usage=usage)
        .select(ids, "usage_start_time", "usage_quantity", "cost")
        .where(F.col("r.id").isNotNull())
        .groupBy(F.col("r.type").alias("resource_type"), F.col("r.id").alias("resource_id"))
        .agg(F.min("usage_start_time").alias("first_billing_time"), _units(3), _cost())
    )


def warehouse_sessions(ctx: Ctx, lookback: int = 365) -> DataFrame:
    """The last session of each warehouse; one that began before the look-back starts with it."""
    warehouse = F.col("usage_metadata.warehouse_id")
    usage = ctx.recent("billing.usage", "usage_date", lookback).where(warehouse.isNotNull())
    return last_sessions(priced_usage(ctx, usage=usage).withColumn("warehouse_id", warehouse), "warehouse_id")


@report("warehouse_session")
def warehouse_session(ctx: Ctx) -> DataFrame:
    return warehouse_sessions(ctx).select(
        "warehouse_id", "session_start", rnd("units", 3).alias("units"), rnd("cost", 2).alias("cost")
    )


@report("join_cross_scalar")
def session_row_counts(ctx: Ctx) -> DataFrame:
    """Metered rows since each warehouse's session start, for all warehouses at once."""
    return warehouse_sessions(ctx).select("warehouse_id", "session_start", "row_count")


@report("job_cost_30d")
def job_cost_30d(ctx: Ctx, n: int | None = None) -> DataFrame:
    keys = ["job_id", "workspace_id", "sku_name"]
    run_days = _job_rows(priced_usage(ctx, 30)).groupBy(*keys, "usage_date", "usage_metadata.job_run_id").agg(
        F.sum("usage_quantity").alias("usage_quantity"), F.sum("cost").alias("cost"),
        F.min("usage_start_time").alias("_first"), F.max("usage_start_time").alias("_last"),
    )
    rows = run_days.groupBy(*keys).agg(
        F.count_distinct("job_run_id").alias("run_count"), _units(), _cost(), F.min("_first").alias("first_run"),
        F.max("_last").alias("last_run"), F.count_distinct("usage_date").alias("active_days"),
    )
    return with_workspace(ctx, _with_job_name(ctx, top(rows, n, desc("cost"))), "workspace_name").orderBy(
        desc("cost"), "job_id"
    )


@report("join_job_name")
def join_job_name(ctx: Ctx) -> DataFrame:
    """Units of every job in the period with the name of its latest version, if it still exists."""
    rows = _job_rows(priced_usage(ctx, 30)).groupBy("workspace_id", "job_id").agg(_units())
    return _with_job_name(ctx, rows)


@report("semi_active_filters")
def semi_active_filters(ctx: Ctx) -> DataFrame:
    active = _recent_usage(ctx).select("workspace_id").distinct()
    return (
        workspace_names(ctx).join(active, "workspace_id", "left_semi")
        .groupBy("subscription_id").agg(F.count("*").alias("workspaces"))
    )


# ---- workspace directory ----

# Display names of entitlement codes; others are shown with words capitalised.
ENTITLEMENT_LABELS = {
    "workspace-admin": "Workspace Admin",
    "allow-cluster-create": "Can Create Clusters",
    "allow-instance-pool-create": "Can Create Instance Pools",
}


@report("workspace_access")
def workspace_access(ctx: Ctx) -> DataFrame:
    """One row per workspace, principal and permission, with the workspace's principal count."""
    a = scope_workspaces(ctx, ctx.table("directory.workspace_assignments"))
    kind = (
        F.when(F.col("group_name").isNotNull(), "Group")
        .when(F.col("service_principal_name").isNotNull(), "Service Principal").otherwise("User")
    )
    rows = a.select(
        "workspace_id", kind.alias("principal_type"),
        F.coalesce("group_name", "service_principal_name", "user_name").alias("principal"), "permission",
    ).where(F.coalesce("principal", F.lit("")) != "")
    counts = rows.groupBy("workspace_id").agg(
        F.count_distinct("principal_type", "principal").alias("principal_count")
    )
    return with_workspace(ctx, rows.join(counts, "workspace_id"), "workspace_name")


@report("workspace_groups")
def workspace_groups(ctx: Ctx) -> DataFrame:
    """One row per group and entitlement label (NULL when it has none), with the member count."""
    raw = F.col("entitlement")
    label = F.coalesce(C.lookup(raw, ENTITLEMENT_LABELS), F.initcap(F.replace(raw, F.lit("-"), F.lit(" "))))
    rights = ctx.table("directory.group_entitlements").select("group_name", label.alias("entitlement")).distinct()
    members = ctx.table("directory.group_members").groupBy("group_name").agg(F.count("*").alias("member_count"))
    return (
        ctx.table("directory.groups").select("group_name")
        .join(members, "group_name", "left").join(rights, "group_name", "left")
        .select("group_name", F.coalesce("member_count", F.lit(0)).alias("member_count"), "entitlement")
    )


@report("workspace_users")
def workspace_users(ctx: Ctx) -> DataFrame:
    emails = F.col("emails")
    primary = F.get(F.filter(emails, lambda e: e["primary"]), F.lit(0))["value"]
    return ctx.table("directory.users").select(
        "display_name", F.coalesce(primary, F.get(emails, F.lit(0))["value"], F.lit("")).alias("email"),
        F.coalesce("active", F.lit(True)).alias("active"),
    ).orderBy(F.lower("display_name"))
