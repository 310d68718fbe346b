"""Daily spikes of spend series over a stream, with each series' daily totals as keyed state.

Rows are added up per series and day where they are read, so the state of a series gets a few rows a task, however many
rows a day has. The state holds one decimal total per day of the history; a timer takes days out that no rule looks at
any more, also when nothing arrives. Whenever a series changes, all alerts of its present totals are emitted, or one row
without a type if there are none: the last batch of a series says what holds.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ALERTS = "series string, type string, severity string, subject string, value double, baseline double, pct_change double"
_DAY_MS = 86_400_000


def cents(x: Decimal) -> float:
    return float(x.quantize(Decimal("0.01"), ROUND_HALF_UP))


@dataclass(frozen=True)
class SpikeRule:
    """Days of history, newest rows that are judged, and how often the mean of the others a day must cost."""

    history_days: int
    recent_rows: int
    factor: float


def spikes_of(daily: dict[str, Decimal], rule: SpikeRule) -> list[tuple[str, float, float]]:
    """(day, cost, baseline) of the newest days above twice the mean of the older ones; days as ISO text.

    The same rule as the batch report's: rows, not calendar days, and all of them where there are few.
    """
    days = sorted(daily, reverse=True)
    cost = {d: cents(daily[d]) for d in days}
    old = days[rule.recent_rows :] or days
    baseline = sum(cost[d] for d in old) / len(old) if old else 0.0
    return [(d, cost[d], baseline) for d in days[: rule.recent_rows] if baseline > 0 and cost[d] > baseline * rule.factor]


class DailySpikes(StatefulProcessor):
    def __init__(self, rule: SpikeRule) -> None:
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day string", "cost string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for part in rows:
            for day, cost in zip(part["day"], part["cost"], strict=True):
                held = self.days.getValue((day,))
                self.days.updateValue((day,), (str((Decimal(held[0]) if held else Decimal(0)) + cost),))
        daily = {k[0]: Decimal(v[0]) for k, v in self.days.iterator()}
        newest = max(daily)
        self._forget(daily, dt.date.fromisoformat(newest) - dt.timedelta(days=self.rule.history_days))
        end = dt.datetime.fromisoformat(newest).replace(tzinfo=dt.UTC) + dt.timedelta(days=self.rule.history_days + 1)
        self.handle.registerTimer(int(end.timestamp() * 1000))
        yield self._alerts(key[0], daily)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Time has passed without newer days: those out of the window leave the state."""
        today = dt.datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, dt.UTC).date()
        daily = {k[0]: Decimal(v[0]) for k, v in self.days.iterator()}
        self._forget(daily, today - dt.timedelta(days=self.rule.history_days))
        if daily:
            self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + _DAY_MS)
        yield self._alerts(key[0], daily)

    def _forget(self, daily: dict[str, Decimal], before: dt.date) -> None:
        for day in [d for d in daily if d < before.isoformat()]:
            self.days.removeKey((day,))
            del daily[day]

    def _alerts(self, series: str, daily: dict[str, Decimal]) -> pd.DataFrame:
        found = [(series, "DAILY_SPIKE", "HIGH", d, cents(Decimal(repr(c))), cents(Decimal(repr(b))), None) for d, c, b in spikes_of(daily, self.rule)]
        frame = pd.DataFrame(found or [(series, *[None] * 6)], columns=[c.split()[0] for c in ALERTS.split(", ")])
        return frame.astype({"value": float, "baseline": float, "pct_change": float})


def daily_spike_alerts(costs: DataFrame, rule: SpikeRule) -> DataFrame:
    """Alerts over a stream of (series, usage_start_time, usage_date, cost); see the module for what is emitted."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sums = pa.Table.from_batches([batch]).group_by(["series", "day"]).aggregate([("cost", "sum"), ("at", "max")])
                sums = sums.select(["series", "day", "cost_sum", "at_max"]).rename_columns(["series", "day", "cost", "at"])
                yield from sums.cast(pa.schema([("series", pa.string()), ("day", pa.string()), ("cost", pa.decimal128(38, 10)), ("at", batch.schema.field("at").type)])).to_batches()

    rows = costs.select("series", F.date_format("usage_date", "yyyy-MM-dd").alias("day"), F.col("cost").cast("decimal(28,10)").alias("cost"), F.col("usage_start_time").alias("at"))
    summed = rows.mapInArrow(add_up, "series string, day string, cost decimal(38,10), at timestamp").withWatermark("at", f"{rule.history_days} days")
    return summed.groupBy("series").transformWithStateInPandas(DailySpikes(rule), StructType.fromDDL(ALERTS), "Update", "EventTime")


def with_rocks(spark: SparkSession, run) -> None:
    """Keyed state with maps and timers needs this store; the session's own setting comes back afterwards."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        run()
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def present_alerts(spark: SparkSession, path: str) -> DataFrame:
    """What holds after all batches written by ``runner.batch_writer``: the alerts of each series' last batch."""
    rows = spark.read.parquet(path)
    last = rows.groupBy(F.col("series").alias("s")).agg(F.max("batch").alias("b"))
    return rows.join(last, (F.col("series") == F.col("s")) & (F.col("batch") == F.col("b"))).where("type IS NOT NULL").drop("s", "b", "batch")
