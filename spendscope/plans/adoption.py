"""User adoption from audit logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendscope.context import Ctx
from spendscope.functions import classify as C
from spendscope.functions.measures import desc, top
from spendscope.operators import sketches
from spendscope.plans.registry import report
from spendscope.sources.sinks import shared_folder, write_partitioned

AUDIT = "access.audit"
LOOKBACK = 90
EMAIL = "user_identity.email"


def _events(ctx: Ctx, days: int = LOOKBACK) -> DataFrame:
    return ctx.recent(AUDIT, "event_date", days).where(C.is_known_user(F.col(EMAIL)))


def _users(exact: bool, name: str) -> Column:
    """Distinct users, or a HyperLogLog estimate for dashboards over very large logs."""
    count = F.count_distinct(EMAIL) if exact else F.approx_count_distinct(EMAIL)
    return count.alias(name)


def _activity(ctx: Ctx) -> DataFrame:
    """Counted per user, day, workspace and service first; the distinct counts see those rows only."""
    cells = _events(ctx).groupBy(F.col(EMAIL).alias("user_email"), "event_date", "workspace_id", "service_name").agg(
        F.max("event_time").alias("_last"), F.count("*").alias("_n")
    )
    return cells.groupBy("user_email").agg(
        F.max("_last").alias("last_active"), F.sum("_n").alias("action_count"),
        F.count_distinct("event_date").alias("active_days"),
        F.count_distinct("workspace_id").alias("workspaces_accessed"),
        F.count_distinct("service_name").alias("services_used"),
    )


@report("user_activity")
def user_activity(ctx: Ctx, n: int | None = None) -> DataFrame:
    return top(_activity(ctx), n, desc("action_count"))


@report("daily_active_users")
def daily_active_users(ctx: Ctx, exact: bool = True) -> DataFrame:
    return _events(ctx).groupBy("event_date").agg(
        _users(exact, "active_users"), F.count("*").alias("total_actions")
    ).orderBy("event_date")


def user_sketches(ctx: Ctx, days: int = 30) -> DataFrame:
    """What is kept of each day: a sketch of its users and of the services used."""
    return sketches.of_days(_events(ctx, days), [], "event_date", items={"user": F.col(EMAIL), "service": F.col("service_name")})


def active_from_sketches(ctx: Ctx, kept: DataFrame) -> DataFrame:
    """Users of the last day, seven and thirty days, without the raw events."""
    since = lambda n: F.col("event_date") >= F.lit(ctx.back(n, AUDIT))
    return kept.agg(
        sketches.distinct("user", since(1)).alias("active_1d"), sketches.distinct("user", since(7)).alias("active_7d"),
        sketches.distinct("user").alias("active_30d"), sketches.distinct("service").alias("services_30d"), F.sum("row_count").alias("total_actions"),
    )


@report("active_users_sketched")
def active_users_sketched(ctx: Ctx) -> DataFrame:
    path = shared_folder(ctx.spark, "user-sketches")
    write_partitioned(user_sketches(ctx), path, ("event_date",))
    return active_from_sketches(ctx, ctx.spark.read.parquet(path))


@report("service_breakdown")
def service_breakdown(ctx: Ctx, exact: bool = True) -> DataFrame:
    return _events(ctx, 30).groupBy("service_name").agg(
        F.count("*").alias("action_count"), _users(exact, "unique_users")
    ).orderBy(desc("action_count"))


@report("top_actions")
def top_actions(ctx: Ctx, exact: bool = True, n: int | None = 50) -> DataFrame:
    rows = _events(ctx, 30).groupBy("service_name", "action_name").agg(
        F.count("*").alias("action_count"), _users(exact, "unique_users")
    )
    return top(rows, n, desc("action_count"))


@report("user_top_service")
def user_top_service(ctx: Ctx) -> DataFrame:
    """Each user's most used service; of equally used ones the first by name."""
    counts = _events(ctx).groupBy(F.col(EMAIL).alias("user_email"), "service_name").agg(F.count("*").alias("n"))
    best = Window.partitionBy("user_email").orderBy(desc("n"), "service_name")
    return counts.withColumn("rn", F.row_number().over(best)).where("rn = 1").select(
        "user_email", F.col("service_name").alias("top_service")
    )


@report("user_classes")
def user_classes(ctx: Ctx) -> DataFrame:
    """All users as human or service principal, with their top service."""
    return _activity(ctx).join(user_top_service(ctx), "user_email", "left").withColumn(
        "is_service_principal", C.is_service_principal(F.col("user_email"))
    )


def _days_idle(ctx: Ctx) -> Column:
    return F.date_diff(F.lit(ctx.day(AUDIT)), F.to_date("last_active"))


@report("inactive_users")
def inactive_users(ctx: Ctx, idle_days: int = 30) -> DataFrame:
    rows = user_classes(ctx).where(~F.col("is_service_principal")).withColumn("days_inactive", _days_idle(ctx))
    return rows.where(F.col("days_inactive") > idle_days).orderBy(desc("days_inactive"), "user_email")


@report("adoption_summary")
def adoption_summary(ctx: Ctx) -> DataFrame:
    human, idle = ~F.col("is_service_principal"), _days_idle(ctx)
    return _activity(ctx).withColumn("is_service_principal", C.is_service_principal(F.col("user_email"))).agg(
        F.count_if(human).alias("total_users"), F.count_if(human & (idle <= 7)).alias("active_7d"),
        F.count_if(human & (idle <= 30)).alias("active_30d"), F.count_if(human & (idle > 30)).alias("inactive"),
        F.count_if(~human).alias("service_principals"),
    )
