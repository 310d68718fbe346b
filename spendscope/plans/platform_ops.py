"""Private endpoints, dashboards, SQL alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.context import Ctx
from spendscope.functions.measures import desc, top
from spendscope.plans.registry import report
from spendscope.sources.catalog import first_col, first_nonempty

LOOKBACK = 30
UNKNOWN = "unknown"


def known(name: str):
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(UNKNOWN)).alias(name)


def counts(df: DataFrame, key, name: str = "row_count") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(name)).orderBy(desc(name))


@report("private_endpoints")
def private_endpoints(ctx: Ctx) -> DataFrame:
    """Endpoint rules under whichever column names the platform release uses, else the other inventory."""
    rules = ctx.table("networking.private_endpoint_rules", optional=True)
    chosen = first_nonempty(rules, ctx.table("networking.vpc_endpoints", optional=True))
    rows = chosen.select(
        "workspace_id", first_col(chosen, "name", "endpoint_name").alias("endpoint_name"),
        first_col(chosen, "private_endpoint_id", "endpoint_id").alias("endpoint_id"),
        first_col(chosen, "resource_id").alias("resource_id"),
        first_col(chosen, "sub_resource_target", "group_id").alias("sub_resource_target"),
        first_col(chosen, "domain", "fqdn").alias("domain"), first_col(chosen, "state", "status").alias("status"),
    )
    return rows.orderBy("workspace_id")


@report("endpoint_status")
def endpoint_status(ctx: Ctx) -> DataFrame:
    return counts(private_endpoints(ctx), known("status"))


@report("endpoints_by_workspace")
def endpoints_by_workspace(ctx: Ctx) -> DataFrame:
    return counts(private_endpoints(ctx), known("workspace_id"))


def _dashboard_events(ctx: Ctx) -> DataFrame:
    """The newer event table when it has rows, else the older one."""
    name = "dashboards.dashboard_events"
    newer = ctx.table("dashboards.published_events", optional=True)
    return first_nonempty(newer, ctx.table(name)).where(ctx.ts_within(name, "event_time", LOOKBACK))


def _board():
    return F.coalesce(F.nullif(F.col("dashboard_name"), F.lit("")), "dashboard_id").alias("dashboard")


@report("dashboard_daily")
def dashboard_daily(ctx: Ctx) -> DataFrame:
    return counts(_dashboard_events(ctx), F.to_date("event_time").alias("day"), "event_count")


@report("top_dashboards")
def top_dashboards(ctx: Ctx, n: int | None = 20) -> DataFrame:
    return top(counts(_dashboard_events(ctx), _board(), "views"), n, desc("views"))


@report("top_dashboard_users")
def top_dashboard_users(ctx: Ctx, n: int | None = 20) -> DataFrame:
    return top(counts(_dashboard_events(ctx), known("user_id"), "event_count"), n, desc("event_count"))


@report("dashboard_event_types")
def dashboard_event_types(ctx: Ctx) -> DataFrame:
    return counts(_dashboard_events(ctx), "event_type", "event_count")


@report("dashboard_usage")
def dashboard_usage(ctx: Ctx) -> DataFrame:
    """Daily, dashboard, user and event-type counts in one frame: section, item, event_count."""
    def section(df: DataFrame, name: str) -> DataFrame:
        item, n = df.columns
        return df.select(F.lit(name).alias("section"), F.col(item).cast("string").alias("item"), F.col(n).alias("event_count"))

    return (
        section(dashboard_daily(ctx), "day").unionByName(section(top_dashboards(ctx), "dashboard"))
        .unionByName(section(top_dashboard_users(ctx), "user")).unionByName(section(dashboard_event_types(ctx), "type"))
    )


@report("dashboard_inventory")
def dashboard_inventory(ctx: Ctx, n: int | None = None) -> DataFrame:
    rows = ctx.table("dashboards.dashboards").select(
        "dashboard_id", F.col("name").alias("dashboard_name"), F.col("owner_username").alias("owner"),
        F.col("created_time").alias("created_at"), F.col("updated_time").alias("updated_at"),
    )
    return top(rows, n, desc("updated_at"))


@report("alert_states")
def alert_states(ctx: Ctx) -> DataFrame:
    return counts(ctx.table("sql.alerts"), known("state"))


@report("platform_summary")
def platform_summary(ctx: Ctx) -> DataFrame:
    n = F.count("*").alias("n")
    return _dashboard_events(ctx).agg(
        F.count("*").alias("dashboard_events"), F.count_distinct(known("user_id")).alias("unique_dash_users")
    ).withColumns({
        "private_endpoints": private_endpoints(ctx).agg(n).scalar(), "dashboards": ctx.table("dashboards.dashboards").agg(n).scalar(),
        "active_alerts": ctx.table("sql.alerts").agg(n).scalar(),
    })
