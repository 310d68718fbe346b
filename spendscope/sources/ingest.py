"""Provider cost exports normalised to one schema."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendscope.functions.classify import lookup

# ---- fixed values: service categories by provider, 'Other' when not listed ----
AWS_CATEGORIES = {
    "Amazon Elastic Compute Cloud": "Compute",
    "AWS Lambda": "Serverless",
    "Amazon Simple Storage Service": "Storage",
    "Amazon Elastic Block Store": "Storage",
    "Amazon Relational Database Service": "Database",
    "Amazon DynamoDB": "Database",
    "Amazon Redshift": "Analytics",
    "Amazon Virtual Private Cloud": "Networking",
    "AWS Data Transfer": "Networking",
    "Amazon CloudFront": "Networking",
    "Amazon SageMaker": "AI / ML",
    "Amazon Bedrock": "AI / ML",
}
GCP_CATEGORIES = {
    "Compute Engine": "Compute",
    "Cloud Run": "Serverless",
    "Google Kubernetes Engine": "Compute",
    "Cloud Storage": "Storage",
    "Persistent Disk": "Storage",
    "Cloud SQL": "Database",
    "BigQuery": "Analytics",
    "Dataproc": "Analytics",
    "Vertex AI": "AI / ML",
    "Cloud Networking": "Networking",
    "Cloud CDN": "Networking",
}
COLUMNS = (
    "cloud_provider", "account_id", "account_name", "usage_date", "service_name", "service_category",
    "sku_description", "usage_unit", "usage_quantity", "unit_price", "cost_usd", "currency", "pricing_model",
    "region", "resource_group", "tags", "ingested_at",
)


def ingest_window(as_of: dt.date, lookback: int) -> tuple[dt.date, dt.date]:
    """First and last day to load: the ``lookback`` days up to yesterday."""
    last = as_of - dt.timedelta(days=1)
    return last - dt.timedelta(days=lookback - 1), last


def in_window(df: DataFrame, as_of: dt.date, lookback: int, day: str = "usage_date") -> DataFrame:
    first, last = ingest_window(as_of, lookback)
    return df.where((F.col(day) >= F.lit(first)) & (F.col(day) <= F.lit(last)))


def unit_price(cost: Column, quantity: Column) -> Column:
    """Cost per unit to eight places, 0 without quantity."""
    price = F.try_divide(cost.cast("double"), quantity.cast("double"))
    return F.coalesce(F.round(price.cast("decimal(28,12)"), 8).cast("double"), F.lit(0.0))


def cast_text(df: DataFrame, ingested_at: str) -> DataFrame:
    """Typed day and load time, and an empty tag map, in the unified column order."""
    return df.withColumns({
        "usage_date": F.to_date("usage_date"), "ingested_at": F.to_timestamp(F.lit(ingested_at)),
        "tags": F.lit(None).cast("map<string,string>"),
    }).select(*COLUMNS)


def _text(name: str, default: str = "") -> Column:
    return F.coalesce(F.col(name), F.lit(default))


def normalize_azure(df: DataFrame, ingested_at: str) -> DataFrame:
    cost, qty = F.coalesce("cost", F.lit(0.0)), F.coalesce("usage_quantity", F.lit(0.0))
    return cast_text(df.select(
        F.lit("azure").alias("cloud_provider"), F.col("subscription_id").alias("account_id"),
        F.col("subscription_id").alias("account_name"), F.substring("usage_day", 1, 10).alias("usage_date"),
        _text("service_name").alias("service_name"), _text("service_category").alias("service_category"),
        _text("meter_name").alias("sku_description"), _text("unit_of_measure").alias("usage_unit"),
        qty.alias("usage_quantity"), unit_price(cost, qty).alias("unit_price"), cost.alias("cost_usd"),
        _text("currency", "USD").alias("currency"), F.lit("ON_DEMAND").alias("pricing_model"),
        _text("resource_location").alias("region"), _text("resource_group_name").alias("resource_group"),
    ), ingested_at)


def normalize_aws(df: DataFrame, ingested_at: str, accounts: Sequence[str] = ()) -> DataFrame:
    """Pricing model from the usage type's wording; ``accounts``, when given, is an allow-list."""
    if accounts:
        df = df.where(F.col("linked_account").isin(*accounts))
    usage, cost, qty = F.lower("usage_type"), F.col("unblended_cost"), F.col("usage_quantity")
    model = (
        F.when(usage.contains("spot"), "SPOT")
        .when(usage.contains("heavyusage") | usage.contains("partialupfront"), "RESERVED_1Y").otherwise("ON_DEMAND")
    )
    return cast_text(df.select(
        F.lit("aws").alias("cloud_provider"), F.col("linked_account").alias("account_id"),
        F.col("linked_account").alias("account_name"), F.col("usage_day").alias("usage_date"),
        F.col("service").alias("service_name"),
        F.coalesce(lookup(F.col("service"), AWS_CATEGORIES), F.lit("Other")).alias("service_category"),
        F.col("usage_type").alias("sku_description"), F.lit("Hrs").alias("usage_unit"), qty.alias("usage_quantity"),
        unit_price(cost, qty).alias("unit_price"), cost.alias("cost_usd"), "currency", model.alias("pricing_model"),
        "region", F.lit("").alias("resource_group"),
    ), ingested_at)


def normalize_gcp(df: DataFrame, ingested_at: str, projects: Sequence[str] = ()) -> DataFrame:
    """Summed per project, day, service, SKU, unit, region and currency; cost includes nested credits."""
    if projects:
        df = df.where(F.col("project_id").isin(*projects))
    region = F.coalesce("location_region", "location_name", F.lit("global"))
    credit = F.aggregate("credits", F.lit(0).cast("decimal(18,4)"), lambda acc, c: (acc + c["amount"]).cast("decimal(18,4)"))
    rows = df.groupBy(
        "project_id", "project_name", F.to_date("usage_start_time").alias("day"), "service_description",
        "sku_description", "pricing_unit", region.alias("region"), "currency",
    ).agg(
        F.coalesce(F.sum("usage_amount"), F.lit(0)).cast("double").alias("qty"),
        (F.coalesce(F.sum("cost"), F.lit(0)) + F.coalesce(F.sum(credit), F.lit(0))).cast("double").alias("total"),
    )
    name = F.coalesce("project_name", "project_id", F.lit(""))
    return cast_text(rows.select(
        F.lit("gcp").alias("cloud_provider"), _text("project_id").alias("account_id"), name.alias("account_name"),
        F.col("day").alias("usage_date"), _text("service_description").alias("service_name"),
        F.coalesce(lookup(_text("service_description"), GCP_CATEGORIES), F.lit("Other")).alias("service_category"),
        _text("sku_description").alias("sku_description"), _text("pricing_unit").alias("usage_unit"),
        F.col("qty").alias("usage_quantity"), unit_price(F.col("total"), F.col("qty")).alias("unit_price"),
        F.col("total").alias("cost_usd"), _text("currency", "USD").alias("currency"),
        F.lit("ON_DEMAND").alias("pricing_model"), "region", F.lit("").alias("resource_group"),
    ), ingested_at)
