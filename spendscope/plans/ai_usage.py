"""AI gateway traffic and model serving spend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.context import Ctx
from spendscope.functions import classify as C
from spendscope.functions.measures import desc, rnd, share_pct, top, total
from spendscope.operators import sketches
from spendscope.operators.pricing import priced_usage
from spendscope.operators.quantiles import exact_percentiles
from spendscope.plans.registry import report
from spendscope.sources.sinks import shared_folder, write_partitioned

GATEWAY = "ai_gateway.usage"
LOOKBACK = 30
LATENCY = "execution_duration_ms"


def _requests(ctx: Ctx) -> DataFrame:
    return ctx.recent_ts(GATEWAY, "event_time", LOOKBACK).withColumn("day", F.to_date("event_time"))


def _traffic():
    return [
        F.count("*").alias("request_count"), F.sum("total_token_count").alias("total_tokens"),
        F.sum("input_token_count").alias("input_tokens"), F.sum("output_token_count").alias("output_tokens"),
        rnd(F.avg(LATENCY), 1).alias("avg_latency_ms"),
    ]


@report("gateway_usage")
def gateway_usage(ctx: Ctx) -> DataFrame:
    return _requests(ctx).groupBy("route_name", "day").agg(
        *_traffic(), rnd(F.sum("total_token_count").cast("double") / 1_000_000, 3).alias("m_tokens")
    ).orderBy("day", desc("request_count"))


@report("gateway_by_user")
def gateway_by_user(ctx: Ctx, n: int | None = None) -> DataFrame:
    rows = _requests(ctx).where(F.col("requester").isNotNull()).groupBy(F.col("requester").alias("user_email")).agg(
        *_traffic(), F.count_distinct("route_name").alias("routes_used")
    )
    return top(rows, n, desc("total_tokens"))


def _serving(ctx: Ctx) -> DataFrame:
    return priced_usage(ctx, LOOKBACK).where(C.is_ai_sku(F.col("sku_name")))


@report("serving_billing")
def serving_billing(ctx: Ctx) -> DataFrame:
    return _serving(ctx).groupBy("sku_name", "workspace_id", "usage_date").agg(
        total("usage_quantity", 4).alias("units"), total("cost", 4).alias("cost")
    ).orderBy("usage_date", desc("cost"))


def _percentiles(df: DataFrame, keys: list[str], wanted: dict[str, float], approximate: bool) -> DataFrame:
    if approximate:
        aggs = [F.percentile_approx(LATENCY, q, 10_000).cast("double").alias(n) for n, q in wanted.items()]
        return df.groupBy(*keys).agg(*aggs)
    return exact_percentiles(df, keys, LATENCY, wanted)


def _rounded(df: DataFrame, names) -> DataFrame:
    return df.withColumns({n: rnd(n, 1) for n in names})


@report("latency_percentiles")
def latency_percentiles(ctx: Ctx, approximate: bool = False) -> DataFrame:
    """Latency per route; requests without output tokens count as errors."""
    wanted = {"p50_ms": 0.5, "p90_ms": 0.9, "p99_ms": 0.99}
    rows = _requests(ctx)
    failed = F.coalesce("output_token_count", F.lit(0)) == 0
    stats = rows.groupBy("route_name").agg(
        F.count("*").alias("request_count"), rnd(F.avg(LATENCY), 1).alias("avg_ms"),
        rnd(F.max(LATENCY), 1).alias("max_ms"), share_pct(F.count_if(failed), F.count("*"), 2).alias("error_rate_pct"),
    )
    marks = _rounded(_percentiles(rows, ["route_name"], wanted, approximate), wanted)
    return stats.join(marks, "route_name", "left").orderBy(desc("request_count"))


LATENCY_MARKS = {"p50_ms": 0.5, "p90_ms": 0.9, "p99_ms": 0.99}


def latency_sketches(ctx: Ctx) -> DataFrame:
    """What is kept of each day: one quantile sketch a route."""
    return sketches.of_days(_requests(ctx), ["route_name"], "day", [LATENCY])


def latency_from_sketches(kept: DataFrame) -> DataFrame:
    return sketches.quantiles(kept, ["route_name"], LATENCY, LATENCY_MARKS)


@report("latency_sketched")
def latency_sketched(ctx: Ctx) -> DataFrame:
    """Latency marks per route from the sketches of its days, and whether their ranks keep the stated error."""
    path = shared_folder(ctx.spark, "latency-sketches")
    write_partitioned(latency_sketches(ctx), path, ("day",))
    marks = latency_from_sketches(ctx.spark.read.parquet(path))
    below = lambda n: F.count_if(F.col(LATENCY) < F.col(n)) / F.count(LATENCY)
    upto = lambda n: F.count_if(F.col(LATENCY) <= F.col(n)) / F.count(LATENCY)
    error = 3 * sketches.RANK_ERROR
    fits = [((below(n) <= q + error) & (upto(n) >= q - error)).alias(f"{n}_in_bound") for n, q in LATENCY_MARKS.items()]
    return _requests(ctx).join(marks, "route_name").groupBy("route_name").agg(F.max("row_count").alias("request_count"), *fits)


@report("latency_daily")
def latency_daily(ctx: Ctx, approximate: bool = False) -> DataFrame:
    wanted = {"p50_ms": 0.5, "p90_ms": 0.9}
    rows = _requests(ctx)
    counts = rows.groupBy("day").agg(F.count("*").alias("request_count"))
    return counts.join(_rounded(_percentiles(rows, ["day"], wanted, approximate), wanted), "day", "left").orderBy("day")


@report("serving_by_user")
def serving_by_user(ctx: Ctx, n: int | None = None) -> DataFrame:
    user = F.coalesce("identity_metadata.run_as", "identity_metadata.created_by", F.lit("unknown"))
    cells = _serving(ctx).groupBy(user.alias("user_email"), "sku_name", "usage_date", "workspace_id").agg(
        F.sum("usage_quantity").alias("usage_quantity"), F.sum("cost").alias("cost")
    )
    rows = cells.groupBy("user_email", "sku_name").agg(
        total("usage_quantity", 4).alias("units"), total("cost", 4).alias("cost"),
        F.count_distinct("usage_date").alias("active_days"), F.count_distinct("workspace_id").alias("workspaces"),
    )
    return top(rows, n, desc("cost"))


@report("gateway_daily")
def gateway_daily(ctx: Ctx) -> DataFrame:
    return gateway_usage(ctx).groupBy("day").agg(
        F.sum("request_count").alias("requests"), F.sum("total_tokens").alias("total_tokens"),
        rnd(F.sum("m_tokens"), 3).alias("m_tokens"),
    ).orderBy("day")


@report("model_breakdown")
def model_breakdown(ctx: Ctx) -> DataFrame:
    """Per model, with the daily mean latencies weighted by requests."""
    weighted = F.sum(F.col("avg_latency_ms") * F.col("request_count")) / F.sum("request_count")
    return gateway_usage(ctx).groupBy(F.coalesce("route_name", F.lit("unknown")).alias("model")).agg(
        F.sum("request_count").alias("requests"), F.sum("total_tokens").alias("total_tokens"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        rnd(weighted, 1).alias("avg_latency_ms"),
    ).orderBy(desc("total_tokens"))


@report("serving_trend")
def serving_trend(ctx: Ctx) -> DataFrame:
    return serving_billing(ctx).groupBy("usage_date").agg(
        rnd(F.sum("units"), 4).alias("units"), rnd(F.sum("cost"), 4).alias("cost")
    ).orderBy("usage_date")


@report("serving_skus")
def serving_skus(ctx: Ctx) -> DataFrame:
    return serving_billing(ctx).groupBy("sku_name").agg(
        rnd(F.sum("units"), 4).alias("units"), rnd(F.sum("cost"), 4).alias("cost")
    ).orderBy(desc("cost"))


@report("ai_summary")
def ai_summary(ctx: Ctx) -> DataFrame:
    totals = _requests(ctx).agg(
        F.count("*").alias("total_requests"), F.coalesce(F.sum("total_token_count"), F.lit(0)).alias("total_tokens"),
        rnd(F.coalesce(F.sum("total_token_count"), F.lit(0)).cast("double") / 1_000_000, 2).alias("total_m_tokens"),
        F.count_distinct("route_name").alias("models_in_use"), F.count_distinct("requester").alias("gateway_users"),
    )
    cost = _serving(ctx).agg(F.coalesce(total("cost"), F.lit(0.0)).alias("c")).scalar()
    return totals.withColumn("total_serving_cost", cost)
