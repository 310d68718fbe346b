"""Latest version of slowly changing dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _tie_breakers(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """Plain columns, then structs and arrays; what holds a map or a variant has no order and is ranked by its JSON."""
    plain, nested = [], []
    for c, t in df.select(*names).dtypes:
        if "map<" in t or "variant" in t:
            nested.append(F.to_json(c, {"ignoreNullFields": "false"}))
        else:
            (nested if t.startswith(("struct", "array")) else plain).append(F.col(c))
    return plain + nested


def latest_version(
    df: DataFrame, keys: Sequence[str], order: str = "change_time", drop_deleted: bool = True
) -> DataFrame:
    """One row per key: the greatest ``order`` value, ties broken by all other columns, in the order of ``_tie_breakers``.

    An aggregate rather than a window: each task keeps one candidate per key before the shuffle, so a
    key with a large part of all versions is as cheap as any other. Deletion is looked at only after
    the latest version is known, so a deleted entity stays deleted.
    """
    rest = [c for c in df.columns if c not in (*keys, order)]
    rank = F.struct(F.col(order), *_tie_breakers(df, rest))
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(order, *rest), rank).alias("_v"))
    out = newest.select(*keys, "_v.*").select(*df.columns)
    return out.where(F.col("delete_time").isNull()) if drop_deleted else out
