"""Sketches kept per day, and the price join that cuts time into stretches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from spendscope.operators import sketches
from spendscope.operators.pricing import join_effective_price, join_price_binned
from spendscope.sources.sinks import write_partitioned
from tests.helpers import prices, ts, usage

DAY = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"k{i % 7}", DAY + dt.timedelta(days=rng.randrange(30)), rng.paretovariate(1.2), f"u{rng.randrange(20_000)}") for i in range(60_000)]
    return spark.createDataFrame([*rows, ("hot", DAY, None, None)], "k string, day date, ms double, who string").persist()


def test_ranks_keep_the_stated_error(spark, events):
    kept = sketches.of_days(events, ["k"], "day", ["ms"])
    wanted = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
    found = sketches.quantiles(kept, ["k"], "ms", wanted).where("k = 'hot'").first()
    values = sorted(r.ms for r in events.where("k = 'hot' AND ms IS NOT NULL").collect())
    for name, q in wanted.items():
        below = sum(v < found[name] for v in values) / len(values)
        assert abs(below - q) < 2 * sketches.RANK_ERROR
    assert found["row_count"] == len(values) + 1


def test_distinct_counts_keep_the_stated_error_in_any_order(spark, events, tmp_path):
    late = events.where("day >= '2024-01-20'")
    for part in (late, events.where("day < '2024-01-20'")):  # later days first
        write_partitioned(sketches.of_days(part, [], "day", items={"who": F.col("who")}), str(tmp_path), ("day",))
    kept = spark.read.parquet(str(tmp_path))
    week = F.col("day") >= F.lit(DAY + dt.timedelta(days=23))
    found = kept.agg(sketches.distinct("who").alias("all"), sketches.distinct("who", week).alias("week")).first()
    exact = events.agg(F.count_distinct("who").alias("all"), F.count_distinct(F.when(week, F.col("who"))).alias("week")).first()
    for name in ("all", "week"):
        assert abs(found[name] / exact[name] - 1) < 3 * sketches.RELATIVE_ERROR
    assert kept.count() == 30 and kept.limit(0).agg(sketches.distinct("who").alias("n")).first()["n"] == 0


def test_a_window_of_days_does_not_read_raw_rows(spark, events, tmp_path):
    write_partitioned(sketches.of_days(events, [], "day", items={"who": F.col("who")}), str(tmp_path), ("day",))
    plan = spark.read.parquet(str(tmp_path)).where("day >= '2024-01-20'").agg(sketches.distinct("who"))._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and plan.count("FileScan") == 1


def test_binned_join_is_the_plain_join(spark):
    rng = random.Random(2)
    rows = [{"start": (ts("2024-01-01") + dt.timedelta(hours=rng.randrange(24 * 200))).isoformat(), "sku": rng.choice(["HOT"] * 8 + ["B", "NONE"])} for _ in range(400)]
    rows += [{"start": s, "sku": "HOT"} for s in ("2024-01-31T00:00:00", "2024-03-01T00:00:00", "2024-02-29T23:59:59")]
    listed = prices(spark, [
        ("HOT", "AWS", "2023-01-01", "2024-01-31", 1), ("HOT", "AWS", "2024-01-31", "2024-03-01", 2), ("HOT", "AWS", "2024-03-05", None, 3),
        ("B", "AWS", "2024-02-01", None, 4), ("B", "AWS", "2030-01-01", None, 9), ("HOT", "GCP", "2020-01-01", None, 7),
    ])
    used = usage(spark, rows)
    key = lambda df: sorted((r.sku_name, r.usage_start_time, r.price, r.is_priced) for r in df.collect())
    plain = join_effective_price(used, listed)
    for days in (1, 30, 400):
        binned = join_price_binned(used, listed, days)
        assert key(binned) == key(plain) and binned.columns == plain.columns
    assert join_price_binned(used.limit(0), listed).count() == 0


def test_one_sku_is_spread_over_many_tasks(spark):
    rows = [{"start": (ts("2024-01-01") + dt.timedelta(days=i)).isoformat(), "sku": "HOT"} for i in range(360)]
    listed = prices(spark, [("HOT", "AWS", "2020-01-01", None, 1)])
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(before, ("-1", "false", "16"), strict=True):
            spark.conf.set(k, v)
        tasks = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks(join_effective_price(usage(spark, rows), listed)) == 1
        assert tasks(join_price_binned(usage(spark, rows), listed, 7)) >= 12
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
