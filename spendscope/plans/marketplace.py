"""Marketplace listings and their events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.context import Ctx
from spendscope.functions.measures import desc, top
from spendscope.plans.platform_ops import counts, known
from spendscope.plans.registry import report

LOOKBACK = 90


def _events(ctx: Ctx) -> DataFrame:
    return ctx.recent_ts("marketplace.listing_events", "event_time", LOOKBACK).select(
        "event_ref", "listing_id", "listing_name", "event_type", "event_time", "consumer_workspace_id"
    )


@report("listing_events")
def listing_events(ctx: Ctx, n: int | None = None) -> DataFrame:
    """The 2000 latest events; the counts below are over all events of the window."""
    return top(_events(ctx), n, desc("event_time"))


@report("listing_event_types")
def listing_event_types(ctx: Ctx) -> DataFrame:
    return counts(_events(ctx), "event_type", "event_count")


@report("listing_daily")
def listing_daily(ctx: Ctx) -> DataFrame:
    return counts(_events(ctx), F.to_date("event_time").alias("day"), "event_count")


@report("consumer_listings")
def consumer_listings(ctx: Ctx, n: int | None = None) -> DataFrame:
    rows = ctx.table("marketplace.consumer_listings").select(
        "listing_id", "listing_name", "provider_name", "status", "listing_type", "installed_on", "installed_catalog"
    )
    return top(rows, n, desc("installed_on"))


@report("provider_listings")
def provider_listings(ctx: Ctx, n: int | None = None) -> DataFrame:
    rows = ctx.table("marketplace.provider_listings").select(
        "listing_id", "listing_name", "status", "listing_type", "created_at", "updated_at"
    )
    return top(rows, n, desc("updated_at"))


@report("top_providers")
def top_providers(ctx: Ctx, n: int | None = 15) -> DataFrame:
    return top(counts(ctx.table("marketplace.consumer_listings"), known("provider_name"), "listings"), n, desc("listings"))


@report("listing_types")
def listing_types(ctx: Ctx) -> DataFrame:
    kind = F.coalesce(F.nullif("listing_type", F.lit("")), F.lit("UNKNOWN")).alias("listing_type")
    return counts(ctx.table("marketplace.consumer_listings"), kind, "listings")


@report("marketplace_summary")
def marketplace_summary(ctx: Ctx) -> DataFrame:
    n, consumer = F.count("*").alias("n"), ctx.table("marketplace.consumer_listings")
    return _events(ctx).agg(
        F.count("*").alias("listing_events"), F.count_distinct("event_type").alias("unique_event_types")
    ).withColumns({
        "consumer_listings": consumer.agg(n).scalar(),
        "provider_listings": ctx.table("marketplace.provider_listings").agg(n).scalar(),
        "unique_providers": consumer.agg(F.count_distinct(known("provider_name")).alias("n")).scalar(),
    })
