"""Streaming forms of batch operators. Each takes a streaming frame and returns one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.functions.classify import product_category
from spendscope.operators.pricing import join_effective_price
from spendscope.operators.rates import streaming_sliding_counts
from spendscope.operators.sessions import MAX_GAP_SECONDS
from spendscope.plans.anomaly import rate_limit, requests


def daily_cost(usage: DataFrame, prices: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Cost per day and product category; rows later than ``lateness`` are dropped."""
    timed = usage.withWatermark("usage_start_time", lateness)
    return (
        join_effective_price(timed, prices)
        .groupBy(F.window("usage_start_time", "1 day"), product_category(F.col("sku_name")).alias("product_category"))
        .agg(F.sum("usage_quantity").alias("units"), F.sum("cost").alias("cost"))
        .select(F.to_date("window.start").alias("usage_date"), "product_category", "units", "cost")
    )


def warehouse_sessions(usage: DataFrame, lateness: str = "2 hours", gap_seconds: int = MAX_GAP_SECONDS) -> DataFrame:
    """Closed sessions per warehouse, emitted once the watermark has passed them.

    A row reaches from its start to ``gap_seconds`` after its end, and overlapping reaches merge, so the
    gap is measured from the latest end so far. The extra millisecond lets a gap of exactly
    ``gap_seconds`` belong to the session, as in the batch form.
    """
    reach = F.unix_timestamp("usage_end_time") - F.unix_timestamp("usage_start_time") + gap_seconds
    warehouse = F.col("usage_metadata.warehouse_id")
    return (
        usage.where(warehouse.isNotNull())
        .withWatermark("usage_start_time", lateness)
        .groupBy(warehouse.alias("warehouse_id"),
                 F.session_window("usage_start_time", F.concat(reach.cast("string"), F.lit(" seconds 1 millisecond"))))
        .agg(F.sum("usage_quantity").alias("units"), F.count("*").alias("row_count"),
             F.max("usage_end_time").alias("session_end"))
        .select("warehouse_id", F.col("session_window.start").alias("session_start"), "session_end", "units", "row_count")
    )


def rate_violations(
    log: DataFrame, seconds: int = 60, slide: int = 5, limit: int | None = None, lateness: str = "1 minute"
) -> DataFrame:
    """Sliding windows in which a client sent more than its tier's limit, or more than ``limit``."""
    timed = requests(log.withWatermark("event_time", lateness))
    counts = streaming_sliding_counts(timed, ["client", "tier"], "event_time", seconds, slide)
    allowed = F.lit(limit) if limit is not None else rate_limit(F.col("tier"), burst=seconds <= 5)
    return counts.where(F.col("n") > allowed)
