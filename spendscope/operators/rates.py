"""Event rates in sliding windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sliding_counts(df: DataFrame, keys: Sequence[str], ts: str, seconds: int, slide: int) -> DataFrame:
    """Events per key in every window of ``seconds`` that slides by ``slide``: keys, window_start, n.

    Events are first counted per slide, then each count is added to the windows that contain it, so raw
    rows are not multiplied by the number of overlapping windows.
    """
    step = F.floor(F.unix_micros(ts) / (slide * 1_000_000))
    per_slide = df.groupBy(*keys, step.alias("_step")).agg(F.count("*").alias("_n"))
    starts = F.explode(F.sequence(F.col("_step") - (seconds // slide - 1), F.col("_step")))
    return per_slide.select(*keys, starts.alias("_start"), "_n").groupBy(*keys, "_start").agg(
        F.sum("_n").alias("n")
    ).select(*keys, F.timestamp_micros(F.col("_start") * (slide * 1_000_000)).alias("window_start"), "n")


def streaming_sliding_counts(df: DataFrame, keys: Sequence[str], ts: str, seconds: int, slide: int) -> DataFrame:
    """The same for a stream with a watermark on ``ts``, in one stateful aggregation."""
    window = F.window(ts, f"{seconds} seconds", f"{slide} seconds")
    return df.groupBy(*keys, window).agg(F.count("*").alias("n")).select(
        *keys, F.col("window.start").alias("window_start"), "n"
    )


def trailing_count(df: DataFrame, keys: Sequence[str], ts: str, seconds: int) -> DataFrame:
    """Each row with the number of rows of its keys in the ``seconds`` up to and including it.

    Time is cut into slices of the window length; every row is also placed, as history only, in the
    next slice. A slice thus sees all it needs, and no task sees a key's whole history.
    """
    second = F.unix_micros(ts)
    own = F.floor(second / (seconds * 1_000_000))
    placed = df.withColumn("_us", second).withColumn(
        "_at", F.explode(F.array(F.struct(own.alias("slice"), F.lit(True).alias("own")),
                                 F.struct((own + 1).alias("slice"), F.lit(False).alias("own"))))
    )
    trailing = (
        Window.partitionBy(*keys, "_at.slice").orderBy("_us").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    )
    return placed.withColumn("trailing", F.count("*").over(trailing)).where("_at.own").drop("_us", "_at")


def trailing_totals(df: DataFrame, keys: Sequence[str], ts: str, seconds: int) -> DataFrame:
    """keys, second, n, trailing: events of each second, and of the ``seconds`` seconds up to and including it.

    Events are counted per second first, so that a key with much of the data is one row per second, and the slices
    of ``trailing_count`` hold at most twice ``seconds`` rows of a key.
    """
    per_second = df.groupBy(*keys, F.unix_seconds(ts).alias("second")).agg(F.count("*").alias("n"))
    own = F.floor(F.col("second") / seconds)
    placed = per_second.withColumn("_at", F.explode(F.array(
        F.struct(own.alias("slice"), F.lit(True).alias("own")), F.struct((own + 1).alias("slice"), F.lit(False).alias("own")),
    )))
    trailing = Window.partitionBy(*keys, "_at.slice").orderBy("second").rangeBetween(-(seconds - 1), 0)
    return placed.withColumn("trailing", F.sum("n").over(trailing)).where("_at.own").drop("_at")
