"""Inputs: catalog resolution, ingestion, upserts, configuration, data quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendscope.context import Ctx
from spendscope.functions.measures import rnd, total
from spendscope.operators.pricing import join_price_binned, priced_usage
from spendscope.plans.registry import report
from spendscope.sources import ingest, permissions, quality
from spendscope.sources.catalog import first_col, first_nonempty
from spendscope.sources.live import LiveTable
from spendscope.sources.sinks import COST_KEYS, shared_folder, write_partitioned



def _row_counts(ctx: Ctx, names, optional: bool = False) -> DataFrame:
    out = None
    for name in names:
        rows = ctx.table(name, optional=optional).agg(F.count("*").alias("row_count"))
        rows = rows.select(F.lit(name).alias("table_name"), "row_count")
        out = rows if out is None else out.unionByName(rows)
    return out


@report("src_catalog")
def src_catalog(ctx: Ctx) -> DataFrame:
    """Rows of every logical table that the catalog knows."""
    return _row_counts(ctx, ctx.catalog.names())


@report("src_missing_empty")
def src_missing_empty(ctx: Ctx) -> DataFrame:
    """A table that is not there is an empty one when it is optional."""
    return _row_counts(ctx, ("access.workspaces_latest", "networking.vpc_endpoints"), optional=True)


@report("src_column_drift")
def src_column_drift(ctx: Ctx) -> DataFrame:
    """Alternative column names of endpoint rules resolved to one."""
    df = ctx.table("networking.private_endpoint_rules")
    return df.select(
        first_col(df, "name", "endpoint_name").alias("endpoint_name"), first_col(df, "domain", "fqdn").alias("domain"),
        first_col(df, "state", "status").alias("status"), first_col(df, "region").alias("region"),
    )


@report("src_first_nonempty")
def src_first_nonempty(ctx: Ctx) -> DataFrame:
    """Falls back from an absent event table to the older one."""
    rows = first_nonempty(ctx.table("dashboards.published_events", optional=True), ctx.table("dashboards.dashboard_events"))
    return rows.groupBy("event_type").agg(F.count("*").alias("row_count"))


# ---- ingestion ----


def _stamp(ctx: Ctx) -> str:
    return f"{ctx.day()} 06:00:00"


def unified_export(ctx: Ctx, provider: str, accounts: Sequence[str] = ()) -> DataFrame:
    """All rows of a provider's export, or those of ``accounts`` (AWS) or projects (GCP)."""
    if provider == "azure":
        return ingest.normalize_azure(ctx.table("platform.azure_export"), _stamp(ctx))
    if provider == "aws":
        return ingest.normalize_aws(ctx.table("platform.aws_export"), _stamp(ctx), accounts)
    return ingest.normalize_gcp(ctx.table("platform.gcp_export"), _stamp(ctx), accounts)


def _export_totals(df: DataFrame, *keys: str) -> DataFrame:
    """Sums in DECIMAL, so that they do not depend on the order of rows."""
    return df.groupBy("cloud_provider", "account_id", *keys, "pricing_model", "currency").agg(
        F.count("*").alias("row_count"), total(F.col("usage_quantity").cast("decimal(18,4)"), 4).alias("usage_quantity"),
        rnd(F.sum(F.col("unit_price").cast("decimal(18,8)")), 4).alias("unit_prices"),
        total(F.col("cost_usd").cast("decimal(18,4)"), 4).alias("cost_usd"),
    )


@report("ingest_azure_costs")
def ingest_azure_costs(ctx: Ctx) -> DataFrame:
    return _export_totals(unified_export(ctx, "azure"), "service_category", "region")


@report("ingest_aws_costs")
def ingest_aws_costs(ctx: Ctx) -> DataFrame:
    return _export_totals(unified_export(ctx, "aws"), "service_category", "region")


@report("ingest_gcp_costs")
def ingest_gcp_costs(ctx: Ctx) -> DataFrame:
    return _export_totals(unified_export(ctx, "gcp"), "account_name", "service_category", "region")


@report("ingest_window")
def ingest_window(ctx: Ctx, lookback: int = 30) -> DataFrame:
    rows = ingest.in_window(unified_export(ctx, "azure"), ctx.day(), lookback)
    return rows.groupBy("usage_date").agg(F.count("*").alias("row_count"))


@report("ingest_cast")
def ingest_cast(ctx: Ctx) -> DataFrame:
    """Days are dates, the load time is a timestamp, the tag map is NULL."""
    return unified_export(ctx, "aws").groupBy("usage_date", "ingested_at", F.col("tags").isNull().alias("no_tags")).agg(
        F.count("*").alias("row_count")
    )


def _keyed_costs(costs: DataFrame) -> DataFrame:
    """Unified costs, one row per merge key."""
    return costs.groupBy(*COST_KEYS).agg(
        F.sum("cost_usd").cast("decimal(18,4)").alias("cost_usd"), F.count("*").cast("bigint").alias("row_count")
    )


MONTHLY = ("cloud_provider", "usage_month")
MONTHLY_KEYS = (*COST_KEYS, "usage_month")


def by_month(costs: DataFrame) -> DataFrame:
    """With the month to partition by: seven years of days of some twenty rows each would be thousands of small files."""
    return costs.withColumn("usage_month", F.trunc("usage_date", "month"))


def _cost_totals(df: DataFrame) -> DataFrame:
    return df.groupBy("cloud_provider", "usage_date").agg(
        F.count("*").alias("row_count"), total("cost_usd").alias("cost_usd")
    )


def _correction(ctx: Ctx) -> DataFrame:
    """A reload of the last three days at twice the cost, with a new account in one place."""
    rows = _keyed_costs(ctx.recent("platform.cloud_costs", "usage_date", 2)).withColumn("cost_usd", (F.col("cost_usd") * 2).cast("decimal(18,4)"))
    fresh = rows.where(F.col("account_id") == "acct-1").withColumn("account_id", F.lit("acct-new"))
    return rows.unionByName(fresh)


@report("sink_partitioned")
def sink_partitioned(ctx: Ctx) -> DataFrame:
    """Costs written by provider and month, then read back."""
    path = shared_folder(ctx.spark, "cloud-costs")
    write_partitioned(by_month(_keyed_costs(ctx.table("platform.cloud_costs"))), path, MONTHLY)
    return _cost_totals(ctx.spark.read.parquet(path))


def stored_costs(ctx: Ctx, purpose: str) -> LiveTable:
    """All costs of the unified table by provider and month, in a folder of their own."""
    table = LiveTable(ctx.spark, shared_folder(ctx.spark, purpose), MONTHLY, MONTHLY_KEYS)
    table.write(by_month(_keyed_costs(ctx.table("platform.cloud_costs"))))
    return table


@report("upsert_cloud_costs")
def upsert_cloud_costs(ctx: Ctx) -> DataFrame:
    """Totals after merging the correction into the table, twice: the second load changes nothing."""
    table = stored_costs(ctx, "cloud-costs")
    for _ in range(2):
        table.upsert(by_month(_correction(ctx)))
    return _cost_totals(table.read())


@report("upsert_permissions")
def upsert_permissions(ctx: Ctx) -> DataFrame:
    """A batch that changes, adds and removes users of every tenth customer."""
    table = ctx.table("platform.user_permissions")
    number = F.regexp_extract("email", "([0-9]+)@", 1).cast("bigint")
    changed = table.where(number % 10 < 3).select(
        F.when(number % 10 == 1, F.concat(F.lit("new-"), "email")).otherwise(F.upper("email")).alias("email"),
        F.when(number % 10 != 2, F.lit('{"tabs": ["audit"]}')).alias("config"), F.lit("owner@example.com").alias("updated_by"),
        F.lit(1).alias("change_no"),
    )
    stamp = F.to_timestamp(F.lit(_stamp(ctx)))
    return permissions.upsert_permissions(table, changed, stamp)


@report("read_permissions")
def read_permissions(ctx: Ctx) -> DataFrame:
    """One row per user and tag, the tag NULL for users without tags."""
    rows = permissions.parse_permissions(ctx.table("platform.user_permissions"))
    return rows.select(
        "email", "is_valid", F.array_join("allowed_tabs", ",").alias("tabs"), F.array_join("workspaces", ",").alias("workspaces"),
        F.explode_outer("tags").alias("_t"),
    ).select("email", "is_valid", "tabs", "workspaces", F.col("_t.key").alias("tag_key"), F.col("_t.value").alias("tag_value"))


# ---- quality ----


def landing_rules(ctx: Ctx) -> dict[str, tuple[DataFrame, dict[str, Column]]]:
    """The tables that arrive from outside, and the rules for their rows."""
    q, c = quality, F.col
    return {
        "usage": (ctx.table("landing.usage"), {
            "usage.usage_date": q.is_plausible_day(c("usage_date"), ctx.day()), "usage.workspace_id": q.matches(c("workspace_id"), q.WORKSPACE_ID),
            "usage.sku_name": q.matches(c("sku_name"), q.SKU), "usage.tag_keys": F.forall(F.map_keys("custom_tags"), lambda k: q.matches(k, q.TAG_KEY)),
            "usage.tag_values": F.forall(F.map_values("custom_tags"), lambda v: v.isNull() | q.matches(v, q.TAG_VALUE)),
        }),
        "audit": (ctx.table("access.audit").select("event_id", "user_identity"), {
            "audit.identity": q.is_identity(c("user_identity.email")), "audit.email": q.is_email(c("user_identity.email")),
        }),
        "workspaces": (ctx.table("landing.workspaces"), {
            "workspace.subscription": q.matches(c("subscription_id"), q.SUBSCRIPTION), "workspace.resource_group": q.matches(c("resource_group"), q.RESOURCE_GROUP),
        }),
        "tables": (ctx.table("landing.tables"), {"table.name": q.matches(c("table_name"), q.IDENTIFIER)}),
        "configs": (permissions.parse_permissions(ctx.table("landing.user_permissions")), {
            "config.json": c("is_valid"), "config.tabs": q.is_tab_list(c("allowed_tabs")), "config.workspaces": q.is_workspace_list(c("workspaces")),
        }),
        "settings": (ctx.table("landing.alert_settings"), {"settings.threshold": q.is_threshold(c("threshold_pct")), "settings.email": q.is_email(c("email"))}),
        "prices": (q.with_overlap(ctx.table("landing.list_prices")), {"prices.no_overlap": ~c("overlaps"), "prices.window": c("price_end_time").isNull() | (c("price_end_time") > c("price_start_time"))}),
    }


@report("dq_validate")
def dq_validate(ctx: Ctx) -> DataFrame:
    """How many rows of the landing tables pass each rule; accepted and quarantined rows are written apart in the same pass."""
    folder = shared_folder(ctx.spark, "quality")
    results = [r for name, (df, rules) in landing_rules(ctx).items() for r in quality.split(df, rules, f"{folder}/{name}").results]
    return ctx.spark.createDataFrame(results, "rule string, passed bigint, failed bigint")


@report("dq_quarantine")
def dq_quarantine(ctx: Ctx) -> DataFrame:
    """The usage records that were held back, with the rules they break."""
    held = quality.split(*landing_rules(ctx)["usage"], shared_folder(ctx.spark, "quarantine")).quarantined
    return held.select("record_id", F.array_join("broken_rules", ",").alias("broken_rules"))


@report("dq_rejects")
def dq_rejects(ctx: Ctx) -> DataFrame:
    """Audit rows whose actor is not a proper identity or e-mail address."""
    email = F.col("user_identity.email")
    rules = {"identity": quality.is_identity(email), "email": quality.is_email(email)}
    bad = quality.rejects(ctx.table("access.audit"), rules)
    return bad.select("event_id", email.alias("email"), F.array_join("broken_rules", ",").alias("broken_rules"))


@report("unpriced_usage")
def unpriced_usage(ctx: Ctx) -> DataFrame:
    """Units that cost nothing because no price was in force."""
    return priced_usage(ctx, 30).where(~F.col("is_priced")).groupBy("sku_name", "cloud").agg(
        F.count("*").alias("row_count"), total("usage_quantity").alias("units")
    )


@report("join_effective_price")
def join_effective_price(ctx: Ctx) -> DataFrame:
    """Usage per SKU, cloud and price in force."""
    return _by_price(priced_usage(ctx, usage=ctx.table("billing.usage")))


@report("join_price_binned")
def join_price_in_stretches(ctx: Ctx) -> DataFrame:
    """The same by the join that also cuts time into stretches."""
    return _by_price(join_price_binned(ctx.table("billing.usage"), ctx.table("billing.list_prices")))


def _by_price(priced: DataFrame) -> DataFrame:
    return priced.groupBy("sku_name", "cloud", rnd("price", 6).alias("price")).agg(
        F.count("*").alias("row_count"), total("usage_quantity").alias("units"), total("cost").alias("cost")
    )
