"""Running streams to tables. All writes are repeatable: a batch that is run again replaces itself."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendscope.sources.live import LiveTable
from spendscope.sources.sinks import COST_KEYS, COST_PARTITIONS, matching, upsert_partitions


def run_available(df: DataFrame, checkpoint: str, on_batch: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    """Process everything that is there now, then stop."""
    query = (
        df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(on_batch).start()
    )
    query.awaitTermination()


def append_available(df: DataFrame, checkpoint: str, path: str) -> None:
    """The same into an exactly-once parquet sink, for append-only results."""
    query = (
        df.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).format("parquet").option("path", path).start()
    )
    query.awaitTermination()


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Keeps each batch's changed rows under its number."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def newest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The last value of every key over all batches written by ``batch_writer``."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return last.select(*keys, "_v.*")


def daily_spike_writer(state: str, alerts: str, rule: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Adds each batch's daily totals to ``state`` and writes the alerts of the totals so far.

    Input rows are usage_date and cost; ``rule`` maps a daily series to alerts.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy("usage_date").agg(F.sum("cost").alias("cost")).write.mode("overwrite").parquet(f"{state}/batch={number}")
        daily = batch.sparkSession.read.parquet(state).where(F.col("batch") <= number).groupBy("usage_date").agg(
            F.round(F.sum("cost").cast("decimal(28,10)"), 2).cast("double").alias("cost")
        )
        rule(daily).write.mode("overwrite").parquet(f"{alerts}/batch={number}")

    return write


ARRIVED, BATCH = "arrived_", "last_batch"


def sums_writer(
    table: LiveTable, sums: Callable[[DataFrame], DataFrame], finish: Callable[[DataFrame], DataFrame],
) -> Callable[[DataFrame, int], None]:
    """Upserts what ``finish`` makes of the sums over all rows that arrived for a batch's keys.

    ``sums`` maps a batch to one row per key with additive columns, ``finish`` rows with the running sums under the same
    names to the columns of the table. The running sums are kept in the table, as ``arrived_`` columns, with the number
    of the last batch that a key was met in. So a batch reads and writes only the partitions of its own keys, whatever
    came before, and one that is run again finds its number and adds nothing.
    """
    def write(batch: DataFrame, number: int) -> None:
        new = sums(batch)
        names = [c for c in new.columns if c not in table.keys]

        def add(stored: DataFrame, source: DataFrame) -> DataFrame:
            kinds = dict(source.dtypes)
            extra = {ARRIVED + c: kinds[c] for c in names} | {BATCH: "bigint"}
            missing = {c: F.lit(None).cast(t) for c, t in extra.items() if c not in stored.columns}
            known = stored.withColumns(missing) if missing else stored
            both = known.alias("t").join(source.withColumn("_here", F.lit(True)).alias("s"), matching(table.keys, "t", "s"), "full_outer")
            met = F.col("s._here").isNotNull()
            again = F.coalesce(F.col(f"t.{BATCH}") >= number, F.lit(False))
            before = lambda c: F.coalesce(F.col(f"t.{ARRIVED}{c}"), F.lit(0))
            now = {c: F.when(again | ~met, F.col(f"t.{ARRIVED}{c}")).otherwise((before(c) + F.col(f"s.{c}")).cast(kinds[c])) for c in names}
            rows = both.select(
                *(F.coalesce(f"s.{k}", f"t.{k}").alias(k) for k in table.keys), *(F.col(f"t.{c}").alias(f"old_{c}") for c in stored.columns if c not in (*table.keys, *extra)),
                *(v.alias(ARRIVED + c) for c, v in now.items()), F.when(met, F.greatest(F.lit(number), F.coalesce(f"t.{BATCH}", F.lit(0)))).otherwise(F.col(f"t.{BATCH}")).cast("bigint").alias(BATCH), met.alias("_met"),
            )
            finished = finish(rows.select("*", *(F.col(ARRIVED + c).alias(c) for c in names)))
            values = [c for c in stored.columns if c not in (*table.keys, *extra)]
            return finished.select(*table.keys, *(F.when(F.col("_met"), F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in values), *extra)

        table.upsert(new, add)

    return write


def upsert_writer(
    path: str, arrived: str, prepare: Callable[[DataFrame], DataFrame], keys: Sequence[str] = COST_KEYS,
    partitions: Sequence[str] = COST_PARTITIONS,
) -> Callable[[DataFrame, int], None]:
    """Upserts into the partitioned cost table what ``prepare`` makes of all rows that arrived for a batch's keys.

    For results that are no sums; for those see ``sums_writer``, which does not read what came before. Batches are kept
    under their number in ``arrived``, so a key that is met in several batches gets the result over all of them, and a
    batch that is run again replaces itself.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{arrived}/batch={number}")
        seen = spark.read.parquet(arrived).where(F.col("batch") <= number).select(*batch.columns)
        touched = spark.read.parquet(f"{arrived}/batch={number}").select(*keys).distinct()
        rows = seen.alias("r").join(touched.alias("s"), matching(keys, "r", "s"), "left_semi")
        upsert_partitions(spark, path, prepare(rows), tuple(dict.fromkeys((*keys, *partitions))), partitions)

    return write
