"""Bills of several cloud providers in one schema."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendscope.context import Ctx
from spendscope.functions.measures import change_pct, desc, rnd, top, total
from spendscope.plans.registry import report

TABLE = "platform.cloud_costs"
PROVIDERS = ("azure", "aws", "gcp")


@dataclass(frozen=True)
class CloudFilter:
    start: dt.date | None = None
    end: dt.date | None = None
    provider: str | None = None
    accounts: Sequence[str] = ()


def cloud_filter(ctx: Ctx, p: CloudFilter | None = None, back_to: dt.date | None = None) -> DataFrame:
    """Rows of the period; an unknown provider or an empty account list does not restrict."""
    p = p or CloudFilter()
    start, end = back_to or p.start or ctx.back(30), p.end or ctx.day()
    df = ctx.table(TABLE).where((F.col("usage_date") >= F.lit(start)) & (F.col("usage_date") <= F.lit(end)))
    return _scope(df, p.provider, p.accounts)


def _scope(df: DataFrame, provider: str | None, accounts: Sequence[str] = ()) -> DataFrame:
    if provider and provider.lower() in PROVIDERS:
        df = df.where(F.col("cloud_provider") == provider.lower())
    accounts = [a for a in accounts if a.strip()]
    return df.where(F.col("account_id").isin(*accounts)) if accounts else df


def _cost() -> Column:
    return total("cost_usd").alias("cost_usd")


@report("cloud_filter")
def cloud_filter_totals(ctx: Ctx) -> DataFrame:
    """The filter on one provider and two accounts, and with an unknown provider."""
    one = cloud_filter(ctx, CloudFilter(provider="AWS", accounts=("acct-0", "acct-3", " ")))
    other = cloud_filter(ctx, CloudFilter(provider="nimbus"))

    def sums(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias("row_count"), _cost()).select(F.lit(name).alias("filter"), "row_count", "cost_usd")

    return sums(one, "one").unionByName(sums(other, "unknown"))


@report("cloud_providers")
def cloud_providers(ctx: Ctx) -> DataFrame:
    return ctx.table(TABLE).groupBy("cloud_provider").agg(F.count("*").alias("row_count")).orderBy("cloud_provider")


@report("cloud_accounts")
def cloud_accounts(ctx: Ctx, provider: str | None = None) -> DataFrame:
    return _scope(ctx.table(TABLE), provider).groupBy("cloud_provider", "account_id").agg(
        F.max("account_name").alias("account_name")
    ).orderBy("cloud_provider", "account_name")


@report("cloud_summary")
def cloud_summary(ctx: Ctx, p: CloudFilter | None = None) -> DataFrame:
    """Totals of the period and the change against the days before it, in one pass.

    The earlier window is as many days as lie between start and end, so one day shorter than the period.
    """
    p = p or CloudFilter()
    start, end = p.start or ctx.back(30), p.end or ctx.day()
    span = (end - start).days or 1
    now = F.col("usage_date") >= F.lit(start)

    def of_period(c: str) -> Column:
        return F.when(now, F.col(c))

    cells = cloud_filter(ctx, p, back_to=start - dt.timedelta(days=span)).groupBy(
        "usage_date", "account_id", "service_name", "region"
    ).agg(F.sum("cost_usd").alias("cost_usd"))
    sums = cells.agg(
        rnd(F.coalesce(F.sum(of_period("cost_usd")), F.lit(0)), 2).alias("total_cost_usd"),
        rnd(F.coalesce(F.sum(F.when(~now, F.col("cost_usd"))), F.lit(0)), 2).alias("prev_cost_usd"),
        *[F.count_distinct(of_period(c)).alias(a) for c, a in (
            ("account_id", "account_count"), ("service_name", "service_count"), ("region", "region_count"))],
        F.max(of_period("usage_date")).alias("latest_date"), F.min(of_period("usage_date")).alias("earliest_date"),
    )
    return sums.withColumn("mom_pct", change_pct("total_cost_usd", "prev_cost_usd"))


@report("cloud_daily")
def cloud_daily(ctx: Ctx, p: CloudFilter | None = None) -> DataFrame:
    return cloud_filter(ctx, p).groupBy("usage_date", "cloud_provider").agg(_cost()).orderBy("usage_date", "cloud_provider")


def _accounts() -> Column:
    return F.count_distinct("account_id").alias("account_count")


@report("cloud_by_service")
def cloud_by_service(ctx: Ctx, p: CloudFilter | None = None, n: int = 20) -> DataFrame:
    rows = cloud_filter(ctx, p).groupBy("service_name", "service_category", "cloud_provider").agg(_cost(), _accounts())
    return top(rows, n, desc("cost_usd"))


@report("cloud_by_account")
def cloud_by_account(ctx: Ctx, p: CloudFilter | None = None) -> DataFrame:
    cells = cloud_filter(ctx, p).groupBy("cloud_provider", "account_id", "service_name", "region").agg(
        F.max("account_name").alias("account_name"), F.sum("cost_usd").alias("cost_usd")
    )
    return cells.groupBy("cloud_provider", "account_id").agg(
        F.max("account_name").alias("account_name"), _cost(), F.count_distinct("service_name").alias("service_count"),
        F.count_distinct("region").alias("region_count"),
    ).orderBy(desc("cost_usd"))


@report("cloud_by_region")
def cloud_by_region(ctx: Ctx, p: CloudFilter | None = None, n: int | None = None) -> DataFrame:
    return top(cloud_filter(ctx, p).groupBy("cloud_provider", "region").agg(_cost()), n, desc("cost_usd"))


@report("cloud_by_sku")
def cloud_by_sku(ctx: Ctx, p: CloudFilter | None = None, n: int = 30) -> DataFrame:
    keys = ["cloud_provider", "service_name", "service_category", "sku_description", "usage_unit", "pricing_model"]
    rows = cloud_filter(ctx, p).groupBy(*keys).agg(
        total("usage_quantity").alias("total_quantity"), rnd(F.avg(F.col("unit_price").cast("double")), 8).alias("avg_unit_price"),
        _cost(), _accounts(),
    )
    return top(rows, n, desc("cost_usd"))


@report("cloud_by_category")
def cloud_by_category(ctx: Ctx, p: CloudFilter | None = None) -> DataFrame:
    return cloud_filter(ctx, p).groupBy("service_category", "cloud_provider").agg(_cost()).orderBy(desc("cost_usd"))


@report("cloud_verify")
def cloud_verify(ctx: Ctx) -> DataFrame:
    """Load check: rows and total per provider and pricing model."""
    return ctx.table(TABLE).groupBy("cloud_provider", "pricing_model").agg(
        F.count("*").alias("row_count"), total("cost_usd").alias("total_usd")
    ).orderBy("cloud_provider", "pricing_model")
