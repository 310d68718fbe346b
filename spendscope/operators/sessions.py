"""Gap sessionization without putting one key's whole history into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_GAP_SECONDS = 3600


def last_sessions(usage: DataFrame, key: str, gap_seconds: int = MAX_GAP_SECONDS) -> DataFrame:
    """Start, units and cost of each key's current session.

    A row opens a session when it starts more than ``gap_seconds`` after the end of the row before it.
    Rows are split by key and day: gaps inside a day are found by a window over that day alone, gaps
    across days on one summary row per key and day. Input needs ``usage_date``, ``usage_start_time``,
    ``usage_end_time``, ``usage_quantity`` and ``cost``.
    """
    start, end = F.col("usage_start_time"), F.col("usage_end_time")
    day_key = Window.partitionBy(key, "usage_date")
    in_order = day_key.orderBy(start, end)

    def gap(later, earlier):
        return F.unix_timestamp(later) - F.unix_timestamp(earlier)

    rows = usage.withColumn("_prev_end", F.lag(end).over(in_order)).withColumn(
        "_inner", F.max(F.when(gap(start, F.col("_prev_end")) > gap_seconds, start)).over(day_key)
    )
    counted = F.col("_inner").isNull() | (start >= F.col("_inner"))
    days = rows.groupBy(key, "usage_date").agg(
        F.min(start).alias("_first"),
        F.max(F.struct(start.alias("s"), end.alias("e")))["e"].alias("_last_end"),
        F.max("_inner").alias("_inner"),
        F.sum("usage_quantity").alias("_units"),
        F.sum("cost").alias("_cost"),
        F.sum(F.when(counted, F.col("usage_quantity"))).alias("_units_tail"),
        F.sum(F.when(counted, F.col("cost"))).alias("_cost_tail"),
        F.count("*").alias("_rows"),
        F.count_if(counted).alias("_rows_tail"),
    )
    per_key = Window.partitionBy(key).orderBy("usage_date")
    opened = F.col("_before").isNull() | (gap(F.col("_first"), F.col("_before")) > gap_seconds)
    days = (
        days.withColumn("_before", F.lag("_last_end").over(per_key))
        .withColumn("_opens", F.coalesce(F.col("_inner"), F.when(opened, F.col("_first"))))
        .withColumn("session_start", F.max("_opens").over(Window.partitionBy(key)))
        .where(F.col("usage_date") >= F.to_date("session_start"))
    )
    on_first_day = F.col("usage_date") == F.to_date("session_start")

    def part(whole: str, tail: str):
        return F.sum(F.when(on_first_day, F.col(tail)).otherwise(F.col(whole)))

    return days.groupBy(key, "session_start").agg(
        part("_units", "_units_tail").alias("units"),
        part("_cost", "_cost_tail").alias("cost"),
        part("_rows", "_rows_tail").alias("row_count"),
    )


def event_session_start(events: DataFrame, key: str = "warehouse_id") -> DataFrame:
    """Session start from an event log.

    The oldest RUNNING or STARTING event that is newer than the last STOPPED before the newest such
    event; STOPPED events after it (auto-suspend) are ignored. Three aggregations with map-side
    combining; the joined sides have one row per key.
    """
    starts = events.where(F.col("event_type").isin("RUNNING", "STARTING")).select(key, "event_time")
    newest = starts.groupBy(key).agg(F.max("event_time").alias("_newest"))
    stops = (
        events.where(F.col("event_type") == "STOPPED")
        .select(key, "event_time")
        .join(newest, key)
        .where(F.col("event_time") < F.col("_newest"))
        .groupBy(key)
        .agg(F.max("event_time").alias("_stop"))
    )
    since_stop = F.col("_stop").isNull() | (F.col("event_time") > F.col("_stop"))
    return (
        starts.join(stops, key, "left").where(since_stop).groupBy(key).agg(F.min("event_time").alias("session_start"))
    )
