"""Streaming reports, each run over all data that is there and read back as a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.context import Ctx
from spendscope.functions.measures import rnd
from spendscope.operators.pricing import join_effective_price
from spendscope.plans.alerts import DAY_FACTOR, HISTORY_DAYS, RECENT_ROWS
from spendscope.plans.inputs import _cost_totals, _keyed_costs, by_month, stored_costs
from spendscope.plans.registry import report
from spendscope.sources.sinks import shared_folder
from spendscope.streaming import operators as S
from spendscope.streaming import runner as R
from spendscope.streaming.spikes import SpikeRule, daily_spike_alerts, present_alerts, with_rocks

SPIKES = SpikeRule(HISTORY_DAYS, RECENT_ROWS, DAY_FACTOR)


def _recent(ctx: Ctx, name: str, days: int) -> DataFrame:
    rows = ctx.catalog.stream(name)
    return rows.where((F.col("usage_date") >= F.lit(ctx.back(days))) & (F.col("usage_date") <= F.lit(ctx.day())))


@report("stream_daily_cost")
def stream_daily_cost(ctx: Ctx) -> DataFrame:
    base = shared_folder(ctx.spark, "stream-daily-cost")
    rows = S.daily_cost(_recent(ctx, "billing.usage", 30), ctx.table("billing.list_prices"))
    R.run_available(rows, f"{base}/checkpoint", R.batch_writer(f"{base}/out"))
    out = R.newest(ctx.spark, f"{base}/out", ["usage_date", "product_category"])
    return out.withColumns({"units": rnd("units", 4), "cost": rnd("cost", 2)})


@report("stream_sessions")
def stream_sessions(ctx: Ctx) -> DataFrame:
    base = shared_folder(ctx.spark, "stream-sessions")
    R.append_available(S.warehouse_sessions(_recent(ctx, "billing.usage", 30)), f"{base}/checkpoint", f"{base}/out")
    return ctx.spark.read.parquet(f"{base}/out").withColumn("units", rnd("units", 3))


@report("stream_rate_violations")
def stream_rate_violations(ctx: Ctx, limit: int | None = None) -> DataFrame:
    """Every minute-long window in which a client sent more requests to a tier than it allows, or than ``limit``."""
    base = shared_folder(ctx.spark, "stream-rates")
    rows = S.rate_violations(ctx.catalog.stream("platform.request_log"), limit=limit)
    R.run_available(rows, f"{base}/checkpoint", R.batch_writer(f"{base}/out"))
    return R.newest(ctx.spark, f"{base}/out", ["client", "tier", "window_start"])


@report("stream_spend_alerts")
def stream_spend_alerts(ctx: Ctx) -> DataFrame:
    """Days above twice the baseline of the total spend, from totals that are kept as state of the stream."""
    base = shared_folder(ctx.spark, "stream-alerts")
    rows = join_effective_price(_recent(ctx, "billing.usage", HISTORY_DAYS), ctx.table("billing.list_prices"))
    alerts = daily_spike_alerts(rows.withColumn("series", F.lit("all")), SPIKES)
    with_rocks(ctx.spark, lambda: R.run_available(alerts, f"{base}/checkpoint", R.batch_writer(f"{base}/alerts")))
    return present_alerts(ctx.spark, f"{base}/alerts").drop("series")


@report("stream_upsert_costs")
def stream_upsert_costs(ctx: Ctx) -> DataFrame:
    """All stored costs, then the last three days arriving again as a stream."""
    table = stored_costs(ctx, "stream-costs")

    def doubled(rows: DataFrame) -> DataFrame:
        return rows.withColumn("cost_usd", (F.col("cost_usd") * 2).cast("decimal(18,4)"))

    writer = R.sums_writer(table, lambda batch: by_month(_keyed_costs(batch)), doubled)
    R.run_available(_recent(ctx, "platform.cloud_costs", 2), f"{table.path}-checkpoint", writer, mode="append")
    return _cost_totals(table.read())
