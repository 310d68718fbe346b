"""Exact percentiles per group that stay distributed when one group holds most of the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BANDS_PER_DOUBLING = 512


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, wanted: Mapping[str, float]
) -> DataFrame:
    """Linearly interpolated percentiles, as ``percentile`` gives, one column per entry of ``wanted``.

    The built-in aggregate keeps every distinct value of a group in one task. Here equal values are
    counted before the shuffle, counts are summed over logarithmic value bands to find the bands that
    hold the wanted ranks, and only the values of those bands are ranked. Groups are tied to ranks by
    joins, so the largest unit of work is one band of one group.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count("*").alias("_n"))
        .withColumn("_band", F.signum("_v") * F.floor(F.log2(F.abs(F.col("_v")) + 1) * BANDS_PER_DOUBLING))
    )
    bands = counts.groupBy(*keys, "_band").agg(F.sum("_n").alias("_bn"))
    upto = Window.partitionBy(*keys).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.withColumn("_before", F.coalesce(F.sum("_bn").over(upto), F.lit(0))).withColumn(
        "_total", F.sum("_bn").over(Window.partitionBy(*keys))
    )
    # For each wanted percentile the position p * (n - 1) falls between two zero-based ranks.
    targets = F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), (F.lit(float(q)) * (F.col("_total") - 1)).alias("pos"))
        for name, q in wanted.items()
    ]))
    need = bands.select(*keys, "_band", "_bn", "_before", targets.alias("_t")).withColumns({
        "_name": F.col("_t.name"), "_lo": F.floor("_t.pos"), "_hi": F.ceil("_t.pos"), "_pos": F.col("_t.pos"),
    })
    last_rank = F.col("_before") + F.col("_bn") - 1
    need = need.where((F.col("_lo") <= last_rank) & (F.col("_hi") >= F.col("_before"))).drop("_t", "_bn")

    def renamed(frame: DataFrame, prefix: str) -> DataFrame:
        return frame.withColumnsRenamed({c: prefix + c for c in (*keys, "_band")})

    def same_band(prefix: str):
        return [F.col(k).eqNullSafe(F.col(prefix + k)) for k in keys] + [F.col("_band") == F.col(prefix + "_band")]

    hit_bands = renamed(need.select(*keys, "_band", "_before").distinct(), "h_")
    in_band = Window.partitionBy(*keys, "_band").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        counts.join(hit_bands, same_band("h_"))
        .select(*keys, "_band", "_v", "_n", "_before")
        .withColumn("_end", F.col("_before") + F.sum("_n").over(in_band))
        .withColumn("_begin", F.col("_end") - F.col("_n"))
    )
    wanted_ranks = renamed(need.drop("_before"), "t_")
    joined = ranked.join(wanted_ranks, same_band("t_"))

    def at(rank: str):
        return F.max(F.when((F.col("_begin") <= F.col(rank)) & (F.col(rank) < F.col("_end")), F.col("_v")))

    found = joined.groupBy(*keys, "_name", "_pos", "_lo").agg(at("_lo").alias("_a"), at("_hi").alias("_b"))
    value_at = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_pos") - F.col("_lo"))
    return found.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_name") == name, value_at)).alias(name) for name in wanted
    ])
