"""Effective-dated prices applied to metered usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendscope.context import Ctx


def join_effective_price(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Usage with ``price`` and ``cost``; rows without a price in force cost 0.

    The join is an equi-join on SKU and cloud whose validity window is a residual condition, so the
    optimizer may broadcast the price list when its size allows and sort-merge it otherwise. Window
    starts are inclusive, ends exclusive, a NULL end is open.
    """
    return _join(usage, prices, F.lit(True))


def _join(usage: DataFrame, prices: DataFrame, also: Column, *extra: str) -> DataFrame:
    p = prices.select(
        *extra, F.col("sku_name").alias("_sku"), F.col("cloud").alias("_cloud"),
        "price_start_time", "price_end_time", F.col("pricing.default").alias("_price"),
    )
    in_force = (
        (F.col("sku_name") == F.col("_sku"))
        & (F.col("cloud") == F.col("_cloud"))
        & (F.col("usage_start_time") >= F.col("price_start_time"))
        & also
        & (F.col("price_end_time").isNull() | (F.col("usage_start_time") < F.col("price_end_time")))
    )
    price = F.coalesce(F.col("_price"), F.lit(0))
    return (
        usage.join(p, in_force, "left")
        .withColumns({"price": price, "cost": F.col("usage_quantity") * price, "is_priced": F.col("_price").isNotNull()})
        .drop("_sku", "_cloud", "price_start_time", "price_end_time", "_price")
    )


def join_price_binned(usage: DataFrame, prices: DataFrame, bin_days: int = 30) -> DataFrame:
    """``join_effective_price`` for price lists that are too large to broadcast.

    Both sides also carry the number of a stretch of time, and every price stands once in each stretch that its window
    meets, open windows up to the last usage. The join is on SKU, cloud and stretch, so the use of one SKU is spread
    over as many tasks as it has stretches, where it would be one without. Reads the range of usage times first.
    """
    stretch = lambda c: F.floor(F.unix_seconds(c) / (bin_days * 86_400))
    ends = usage.agg(stretch(F.min("usage_start_time")).alias("a"), stretch(F.max("usage_start_time")).alias("b")).first()
    first, last = (0, -1) if ends["a"] is None else (ends["a"], ends["b"])
    begin = F.greatest(stretch(F.col("price_start_time")), F.lit(first))
    end = F.least(F.coalesce(stretch(F.col("price_end_time")), F.lit(last)), F.lit(last))
    spread = prices.where(begin <= end).withColumn("_stretch", F.explode(F.sequence(begin, end)))
    return _join(usage.withColumn("_bin", stretch(F.col("usage_start_time"))), spread, F.col("_bin") == F.col("_stretch"), "_stretch").drop("_bin", "_stretch")


def priced_usage(ctx: Ctx, days: int | None = None, usage: DataFrame | None = None) -> DataFrame:
    """Priced usage of the last ``days`` days up to today, or of the given usage frame.

    The window is on ``usage_date``, the day of ``usage_start_time``, which prunes partitions.
    """
    if usage is None:
        usage = ctx.recent("billing.usage", "usage_date", days)
    return join_effective_price(usage, ctx.table("billing.list_prices"))
