"""Format and range rules over the input tables: how many rows pass, which are rejected."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

# ---- fixed values: formats ----
WORKSPACE_ID = r"^[A-Za-z0-9_\-]{1,64}$"
SKU = r"^[A-Z0-9_]{1,128}$"
TAG_KEY = r"^[A-Za-z0-9 _\-\.\:]{1,128}$"
TAG_VALUE = r"^[\x20-\x7E]{0,256}$"
IDENTIFIER = r"^[A-Za-z0-9_\-]{1,255}$"
IDENTITY = r"^[a-z0-9][a-z0-9._\-+]{0,127}@[a-z0-9][a-z0-9.\-]{0,127}$"
EMAIL = r"^[a-z0-9][a-z0-9._+\-]{0,127}@[a-z0-9][a-z0-9.\-]{0,126}\.[a-z]{2,}$"
SUBSCRIPTION = r"^[A-Za-z0-9\-]{1,64}$"
RESOURCE_GROUP = r"^[A-Za-z0-9_\-\.()]{1,90}$"
MAX_DATE_RANGE_DAYS = 365
THRESHOLD_RANGE = (1.0, 100.0)
TABS = (
    "executive", "cost", "ml-cost", "audit", "compute", "query", "ai", "access", "lakeflow", "storage", "lineage",
    "governance", "cluster-health", "marketplace", "platform-ops",
)
MAX_TABS, MAX_WORKSPACES = 50, 200
# -------------------------------


def matches(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(pattern), F.lit(False))


def is_identity(c: Column) -> Column:
    return matches(F.lower(F.trim(c)), IDENTITY)


def is_email(c: Column) -> Column:
    return matches(F.lower(F.trim(c)), EMAIL) & ~F.coalesce(c.rlike(r"[\x00-\x1f\x7f]"), F.lit(False))


def is_plausible_day(c: Column, today: dt.date) -> Column:
    """A date no later than tomorrow and no older than two years."""
    low, high = today - dt.timedelta(days=2 * MAX_DATE_RANGE_DAYS), today + dt.timedelta(days=1)
    return F.coalesce((c >= F.lit(low)) & (c <= F.lit(high)), F.lit(False))


def is_threshold(c: Column) -> Column:
    return F.coalesce(F.try_to_number(c.cast("string"), F.lit("999999.99")).between(*THRESHOLD_RANGE), F.lit(False))


def is_tab_list(c: Column) -> Column:
    known = F.forall(c, lambda t: F.coalesce(F.lower(F.trim(t)).isin(*TABS), F.lit(False)))
    return c.isNull() | ((F.size(c) <= MAX_TABS) & known)


def is_workspace_list(c: Column) -> Column:
    return c.isNull() | ((F.size(c) <= MAX_WORKSPACES) & F.forall(c, lambda w: matches(w, WORKSPACE_ID)))


def check(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, passed, failed; all rules of a table in one pass over it."""
    counted = df.agg(F.count("*").alias("_n"), *[F.count_if(ok).alias(f"_p{i}") for i, ok in enumerate(rules.values())])
    rows = F.explode(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.col(f"_p{i}").alias("passed"), (F.col("_n") - F.col(f"_p{i}")).alias("failed"))
        for i, name in enumerate(rules)
    ]))
    return counted.select(rows.alias("_r")).select("_r.*")


@dataclass(frozen=True)
class Split:
    """A table divided by its rules, and per rule how many rows passed and failed."""

    accepted: DataFrame
    quarantined: DataFrame
    results: list[tuple[str, int, int]]


def split(df: DataFrame, rules: dict[str, Column], folder: str) -> Split:
    """Writes ``df`` below ``folder``, accepted rows apart from those that break a rule, and counts in the same pass.

    Quarantined rows carry the names of the rules they break. The counts are observed while the rows are written: no
    second scan, and no shuffle behind them that could be run twice. A rule that is neither true nor false is broken.
    """
    seen = Observation()
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    counts = [F.count_if(F.coalesce(ok, F.lit(False))).alias(f"p{i}") for i, ok in enumerate(rules.values())]
    marked = df.withColumn("broken_rules", broken).observe(seen, F.count(F.lit(1)).alias("n"), *counts)
    marked.withColumn("is_accepted", F.size("broken_rules") == 0).write.partitionBy("is_accepted").parquet(folder)
    found = seen.get
    written = df.sparkSession.read.schema(StructType([*marked.schema.fields, StructField("is_accepted", BooleanType())])).parquet(folder)
    return Split(
        written.where("is_accepted").drop("is_accepted", "broken_rules"), written.where("NOT is_accepted").drop("is_accepted"),
        [(name, found[f"p{i}"], found["n"] - found[f"p{i}"]) for i, name in enumerate(rules)],
    )


def rejects(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows breaking at least one rule, with the names of the broken ones."""
    broken = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]))
    return df.withColumn("broken_rules", broken).where(F.size("broken_rules") > 0)


def overlapping_prices(prices: DataFrame) -> DataFrame:
    """Price windows that begin before an earlier one of their SKU and cloud has ended."""
    return with_overlap(prices).where("overlaps").drop("overlaps")


def with_overlap(prices: DataFrame) -> DataFrame:
    w = Window.partitionBy("sku_name", "cloud").orderBy("price_start_time", "price_end_time")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    far = F.to_timestamp(F.lit("9999-12-31 00:00:00"))
    latest_end = F.max(F.coalesce("price_end_time", far)).over(before)
    return prices.withColumn("overlaps", F.coalesce(F.col("price_start_time") < latest_end, F.lit(False)))
