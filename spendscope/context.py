"""The evaluation context every report takes: where the tables are and which day counts as "today"."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendscope.sources.catalog import Catalog


@dataclass(frozen=True)
class Ctx:
    """Catalog plus the anchor date of all relative windows.

    Nothing in the library reads the wall clock. ``table_days`` overrides the anchor for tables that
    are fresh up to another day. ``allowed_workspaces`` is a frame with one ``workspace_id`` column, or
    None for no row scoping. ``subscription_names`` maps subscription or account ids to display names.
    """

    spark: SparkSession
    catalog: Catalog
    as_of: dt.date
    table_days: Mapping[str, dt.date] = field(default_factory=dict)
    allowed_workspaces: DataFrame | None = None
    subscription_names: Mapping[str, str] = field(default_factory=dict)
    threshold_pct: float = 20.0

    def table(self, name: str, optional: bool = False) -> DataFrame:
        return self.catalog.table(name, optional=optional)

    def day(self, table: str = "") -> dt.date:
        return self.table_days.get(table, self.as_of)

    def back(self, days: int, table: str = "") -> dt.date:
        """The day ``days`` before today."""
        return self.day(table) - dt.timedelta(days=days)

    def recent(self, table: str, date_col: str, days: int) -> DataFrame:
        """Rows of ``table`` from ``days`` days ago up to and including today, by a DATE column."""
        col = F.col(date_col)
        return self.table(table).where(
            (col >= F.lit(self.back(days, table))) & (col <= F.lit(self.day(table)))
        )

    def recent_ts(self, table: str, ts_col: str, days: int, date_col: str | None = None) -> DataFrame:
        """The same for a TIMESTAMP column; half-open at the end of today.

        ``date_col`` names the column with the timestamp's day, by which the table may be partitioned.
        """
        rows = self.table(table) if date_col is None else self.recent(table, date_col, days)
        return rows.where(self.ts_within(table, ts_col, days))

    def ts_within(self, table: str, ts_col: str, days: int) -> Column:
        col = F.col(ts_col)
        upper = self.day(table) + dt.timedelta(days=1)
        return (col >= day_start(self.back(days, table))) & (col < day_start(upper))

    def with_(self, **changes) -> Ctx:
        return replace(self, **changes)


def day_start(day: dt.date) -> Column:
    """Midnight of ``day`` in the session time zone; folds to a literal that reaches the scan."""
    return F.lit(day).cast("timestamp")
