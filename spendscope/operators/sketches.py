"""Quantiles and distinct counts from sketches that are kept per day and merged over any window.

A day's raw rows are read once, when its sketches are made; a week or a month is a merge of a few kilobytes a day, in any
order. Quantiles are KLL sketches, whose error is one of rank; distinct counts are HyperLogLog sketches, exact for small
sets. The exact forms of the reports stay beside these.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KLL_K = 400
RANK_ERROR = 0.007  # of KLL_K, with 99 % confidence
HLL_LG_K = 14
RELATIVE_ERROR = 0.0081  # standard error of HLL_LG_K


def of_days(df: DataFrame, keys: Sequence[str], day: str, values: Sequence[str] = (), items: Mapping[str, Column] | None = None) -> DataFrame:
    """Per key and day: row_count, a quantile sketch ``<value>_kll`` of each value, a distinct sketch ``<name>_hll`` of each item.

    NULLs enter no sketch.
    """
    aggs = [F.count(F.lit(1)).alias("row_count")]
    aggs += [F.kll_sketch_agg_double(F.col(v).cast("double"), F.lit(KLL_K)).alias(f"{v}_kll") for v in values]
    aggs += [F.hll_sketch_agg(c, F.lit(HLL_LG_K)).alias(f"{n}_hll") for n, c in (items or {}).items()]
    return df.groupBy(*keys, day).agg(*aggs)


def quantiles(sketches: DataFrame, keys: Sequence[str], value: str, wanted: Mapping[str, float]) -> DataFrame:
    """row_count and the wanted quantiles of ``value`` over all sketches of a key."""
    merged = sketches.groupBy(*keys).agg(F.sum("row_count").alias("row_count"), F.kll_merge_agg_double(f"{value}_kll", F.lit(KLL_K)).alias("_s"))
    return merged.select(*keys, "row_count", *(F.kll_sketch_get_quantile_double("_s", F.lit(float(q))).alias(n) for n, q in wanted.items()))


def distinct(name: str, when: Column | None = None) -> Column:
    """An aggregate over sketches: how many different items those meeting ``when`` have seen."""
    sketch = F.col(f"{name}_hll")
    return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(sketch if when is None else F.when(when, sketch))), F.lit(0))
