"""Streams over several files equal the batch operators."""

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from spendscope.operators.pricing import join_effective_price
from spendscope.plans.alerts import daily_spikes
from spendscope.plans.streams import SPIKES
from spendscope.sources.sinks import COST_KEYS, upsert, write_partitioned
from spendscope.streaming import operators as S
from spendscope.streaming import runner as R
from spendscope.streaming.spikes import daily_spike_alerts, present_alerts, with_rocks
from tests.helpers import flat_price, ts, usage
from tests.test_sources import _costs


def as_stream(spark, df, path, files=3):
    """The frame as a stream of several files, one per micro-batch, in time order."""
    order = "usage_start_time" if "usage_start_time" in df.columns else df.columns[0]
    rows = df.repartitionByRange(files, order).sortWithinPartitions(order)
    for i in range(files):
        rows.where(F.spark_partition_id() == i).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _usage(spark):
    rnd, t, rows = random.Random(2), ts("2024-01-01T00:00"), []
    for i in range(120):
        t += dt.timedelta(minutes=rnd.choice([10, 40, 90, 200]))
        rows.append({"start": t.isoformat(), "end": (t + dt.timedelta(minutes=30)).isoformat(), "warehouse": f"w{i % 2}", "qty": rnd.randint(1, 9)})
    return usage(spark, rows)


def test_daily_cost(spark, tmp_path):
    u, base = _usage(spark), str(tmp_path)
    R.run_available(S.daily_cost(as_stream(spark, u, f"{base}/in"), flat_price(spark, 2)), f"{base}/cp", R.batch_writer(f"{base}/out"))
    got = {(r.usage_date, float(r.cost)) for r in R.newest(spark, f"{base}/out", ["usage_date", "product_category"]).collect()}
    batch = join_effective_price(u, flat_price(spark, 2)).groupBy("usage_date").agg(F.sum("cost").alias("c"))
    assert got == {(r.usage_date, float(r.c)) for r in batch.collect()}


def test_sessions(spark, tmp_path):
    u, base = _usage(spark), str(tmp_path)
    R.append_available(S.warehouse_sessions(as_stream(spark, u, f"{base}/in")), f"{base}/cp", f"{base}/out")
    got = sorted((r.warehouse_id, r.session_start, r.row_count) for r in spark.read.parquet(f"{base}/out").collect())
    rows = sorted((r.usage_metadata.warehouse_id, r.usage_start_time, r.usage_end_time) for r in u.collect())
    want, newest = [], max(r[1] for r in rows)
    for w in ("w0", "w1"):
        open_ = None
        for _, a, b in (r for r in rows if r[0] == w):
            if open_ and (a - open_[2]).total_seconds() <= 3600:
                open_ = [open_[0], open_[1] + 1, max(open_[2], b)]
            else:
                if open_:
                    want.append((w, open_))
                open_ = [a, 1, b]
        want.append((w, open_))
    closed = newest - dt.timedelta(hours=2)
    want = sorted((w, s[0], s[1]) for w, s in want if s[2] + dt.timedelta(seconds=3600, milliseconds=1) <= closed)
    assert got == want and want


def test_spend_alerts_from_state(spark, tmp_path):
    """Batches, a restart on the same checkpoint and a late day: what holds is what the batch rule says."""
    base, start = str(tmp_path), dt.datetime(2024, 1, 1, 6)
    schema = "series string, usage_start_time timestamp, usage_date date, cost decimal(18,4)"
    rows = [
        (s, start + dt.timedelta(days=i, hours=h), (start + dt.timedelta(days=i)).date(), Decimal(5 + h if not (s == "a" and i == 29) else 20))
        for i in range(30) for h in range(3) for s in ("a", "b")
    ]
    late = [("b", start + dt.timedelta(days=27), (start + dt.timedelta(days=27)).date(), Decimal(100)), ("b", start + dt.timedelta(days=2), (start + dt.timedelta(days=2)).date(), Decimal(1300))]

    def arrive(part, name):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{base}/in/{name}")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*")
        with_rocks(spark, lambda: R.run_available(daily_spike_alerts(stream, SPIKES), f"{base}/cp", R.batch_writer(f"{base}/out")))
        return sorted((r.series, r.subject, r.value, r.baseline) for r in present_alerts(spark, f"{base}/out").collect())

    def batch_rule(part):
        out = []
        for s in ("a", "b"):
            daily = spark.createDataFrame([r for r in part if r[0] == s], schema).groupBy("usage_date").agg(F.sum("cost").cast("double").alias("cost"))
            out += [(s, r.subject, r.value, r.baseline) for r in daily_spikes(daily).collect()]
        return sorted(out)

    arrive(rows[:90], "1")
    arrive(rows[90:], "2")
    first = run()
    assert first == batch_rule(rows) and [r[:2] for r in first] == [("a", "2024-01-30")]
    arrive(late[:1], "3")
    second = run()
    assert second == batch_rule(rows + late[:1]) and [r[:2] for r in second] == [("a", "2024-01-30"), ("b", "2024-01-28")]
    arrive(late[1:], "4")  # raises the baseline: the alert of b is withdrawn
    third = run()
    assert third == batch_rule(rows + late) and [r[:2] for r in third] == [("a", "2024-01-30")]


def test_upserts(spark, tmp_path):
    base = str(tmp_path)
    table, load = _costs(spark, [("a", 1, None, 1), ("b", 2, "g", 2)]), _costs(spark, [("a", 1, None, 5), ("c", 3, None, 6), ("d", 3, "g", 7)])
    write_partitioned(table, f"{base}/table")
    R.run_available(as_stream(spark, load, f"{base}/in"), f"{base}/cp", R.upsert_writer(f"{base}/table", f"{base}/arrived", lambda df: df), mode="append")
    want = {(r.account_id, r.cost_usd) for r in upsert(table, load, COST_KEYS).collect()}
    assert {(r.account_id, r.cost_usd) for r in spark.read.parquet(f"{base}/table").collect()} == want


def test_upserts_add_up_a_key_over_batches(spark, tmp_path):
    base = str(tmp_path)
    load = _costs(spark, [("a", 1, None, 5), ("a", 1, None, 7), ("b", 1, "g", 2), ("b", 1, "g", 4)])
    write_partitioned(_costs(spark, [("a", 1, None, 1), ("z", 1, "g", 3)]), f"{base}/table")
    for i, amount in enumerate((5, 7, 2, 4)):
        load.where(F.col("cost_usd") == amount).coalesce(1).write.mode("append").parquet(f"{base}/in/part{i}")
    stream = spark.readStream.schema(load.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*")
    sums = lambda df: df.groupBy(*COST_KEYS).agg(F.sum("cost_usd").alias("cost_usd"))
    R.run_available(stream, f"{base}/cp", R.upsert_writer(f"{base}/table", f"{base}/arrived", sums), mode="append")
    assert sorted((r.account_id, r.cost_usd) for r in spark.read.parquet(f"{base}/table").collect()) == [("a", 12.0), ("b", 6.0), ("z", 3.0)]
