"""Resources running now: environment tier, time since start, severity, spend of the session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.context import Ctx, day_start
from spendscope.functions import classify as C
from spendscope.functions.measures import desc, rnd
from spendscope.operators.sessions import event_session_start
from spendscope.plans.cost import billing_snapshot, warehouse_session, with_workspace
from spendscope.plans.registry import report

UNTAGGED_CLUSTER_HOURS = 4.0
# Kinds of running resources and the kind of id they are billed under.
BILLED_AS = {"Cluster": "cluster", "SQL Warehouse": "warehouse", "Job Run": "run", "DLT Pipeline": "pipeline"}


@report("warehouse_event_session")
def warehouse_event_session(ctx: Ctx) -> DataFrame:
    name = "compute.warehouse_events"
    events = ctx.table(name).where(F.to_date("event_time") <= F.lit(ctx.day(name)))
    return event_session_start(events)


def _with_sessions(ctx: Ctx, running: DataFrame) -> DataFrame:
    """Session start, units and cost: of warehouses from their session, of others from the snapshot.

    A warehouse's start is the earlier one of its billing session and its event log; a pipeline's is its
    first billed moment.
    """
    snap = billing_snapshot(ctx).withColumnsRenamed({"resource_type": "billed_as", "units": "_units", "cost": "_cost"})
    billed = warehouse_session(ctx).select(
        F.lit("warehouse").alias("billed_as"), F.col("warehouse_id").alias("resource_id"),
        F.col("session_start").alias("_billed_start"), F.col("units").alias("_wh_units"), F.col("cost").alias("_wh_cost"),
    )
    logged = warehouse_event_session(ctx).select(
        F.lit("warehouse").alias("billed_as"), F.col("warehouse_id").alias("resource_id"),
        F.col("session_start").alias("_logged_start"),
    )
    keys, is_wh = ["billed_as", "resource_id"], F.col("billed_as") == "warehouse"
    start = (
        F.when(is_wh, F.least("_billed_start", "_logged_start"))
        .when(F.col("billed_as") == "pipeline", F.col("first_billing_time")).otherwise(F.col("started_at"))
    )
    return (
        running.withColumn("billed_as", C.lookup(F.col("service_type"), BILLED_AS))
        .join(snap, keys, "left").join(billed, keys, "left").join(logged, keys, "left")
        .withColumns({
            "started_at": start,
            "units": F.when(is_wh, F.col("_wh_units")).otherwise(F.col("_units")),
            "cost": F.when(is_wh, F.col("_wh_cost")).otherwise(F.col("_cost")),
        })
        .drop("first_billing_time", "_units", "_cost", "_billed_start", "_wh_units", "_wh_cost", "_logged_start", "billed_as")
    )


@report("running_anomalies")
def running_anomalies(ctx: Ctx) -> DataFrame:
    """Running resources of a known environment, and clusters of an unknown one running four hours or more.

    Durations are in hours up to the start of today; an unknown start is -1 and never more than info.
    """
    rows = with_workspace(ctx, _with_sessions(ctx, ctx.table("live.running_resources")), "workspace_name")
    ran = (F.unix_timestamp(day_start(ctx.day())) - F.unix_timestamp("started_at")) / 3600.0
    hours = F.when(F.col("started_at").isNull(), F.lit(-1.0)).otherwise(F.greatest(F.lit(0.0), ran.cast("double")))
    # inline() gives the tier fields as plain columns, so the long expression is evaluated once per row.
    env = C.env_tier(F.col("name"), F.col("tags"), F.col("workspace_name"))
    rows = rows.withColumn("_h", hours).select("*", F.inline(F.array(env)))
    long_cluster = (F.col("service_type") == "Cluster") & (F.col("_h") >= UNTAGGED_CLUSTER_HOURS)
    rows = rows.where(F.col("tier").isNotNull() | long_cluster)
    tier = F.coalesce("tier", F.lit("other"))
    level = C.severity_by_duration(F.col("_h"), tier, F.col("service_type") == "Job Run")
    rank = F.when(F.col("anomaly_level") == "critical", 0).when(F.col("anomaly_level") == "warning", 1).otherwise(2)
    return rows.select(
        "service_type", "resource_id", "name", "workspace_id", "workspace_name",
        F.coalesce("label", F.lit("unknown")).alias("environment"), tier.alias("env_tier"),
        F.coalesce("source", F.lit("duration")).alias("detected_by"), "started_at",
        rnd("_h", 1).alias("duration_hours"), level.alias("anomaly_level"), "units", "cost",
    ).orderBy(rank, desc("duration_hours"), "name")
