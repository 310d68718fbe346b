"""Small aggregate and rounding helpers shared by the reports. Sums stay DECIMAL, results are DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c: ColumnOrName, places: int) -> Column:
    """Half-up rounding on a decimal with ten places, returned as double."""
    return F.round(col(c).cast("decimal(28,10)"), places).cast("double")


def total(c: ColumnOrName, places: int = 2) -> Column:
    return rnd(F.sum(col(c)), places)


def total_if(cond: Column, c: ColumnOrName, places: int = 2) -> Column:
    """Sum over the rows meeting ``cond``; 0 when there are none."""
    return rnd(F.coalesce(F.sum(F.when(cond, col(c))), F.lit(0)), places)


def share_pct(part: ColumnOrName, whole: ColumnOrName, places: int = 1) -> Column:
    """100 * part / whole, 0 when ``whole`` is 0 or null."""
    ratio = F.try_divide(col(part).cast("double") * 100, col(whole).cast("double"))
    return F.coalesce(rnd(ratio, places), F.lit(0.0))


def change_pct(new: ColumnOrName, old: ColumnOrName, places: int = 1) -> Column:
    """Relative change in percent, 0 when there is nothing to compare with."""
    n, o = col(new).cast("double"), col(old).cast("double")
    return F.coalesce(rnd(F.try_divide((n - o) * 100, o), places), F.lit(0.0))


def minutes_between(start: ColumnOrName, end: ColumnOrName) -> Column:
    return (F.unix_timestamp(col(end)) - F.unix_timestamp(col(start))) / F.lit(60.0)


def hours_between(start: ColumnOrName, end: ColumnOrName) -> Column:
    return (F.unix_timestamp(col(end)) - F.unix_timestamp(col(start))) / F.lit(3600.0)


def top(df: DataFrame, n: int | None, *order: Column) -> DataFrame:
    """First ``n`` rows in ``order``; the remaining columns break ties so that the result is stable.

    Without ``n`` all rows, in no order.
    """
    if n is None:
        return df
    ties = [F.col(c).asc_nulls_last() for c, t in df.dtypes if not t.startswith(("map", "array", "struct"))]
    return df.orderBy(*order, *ties).limit(n)


def desc(name: str) -> Column:
    return F.col(name).desc_nulls_last()
