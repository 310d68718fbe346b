"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where the session names none, a local session gets a temporary folder; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_before.isDefined():
            return set_before.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df``, evaluated once and read back from reliable checkpoint files."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_arrow(
    df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int | None = 1000
) -> DataFrame:
    """``make`` over the Arrow batches of ``df``, ``rows`` at a time to keep a worker small (None: whole batches)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = rows or max(1, batch.num_rows)
            for at in range(0, batch.num_rows, step):
                yield make(batch.slice(at, step))

    return df.mapInArrow(run, schema)


def least_hashed(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The ``rows`` rows with the least hash of ``key``, all if there are fewer.

    The rows are counted first and all but about twice the wanted number are filtered out by their hash where they
    are read, so what is gathered does not grow with the table.
    """
    share = min(1.0, 2 * rows / max(1, df.count()))
    hashed = F.xxhash64(F.col(key))
    few = df if share == 1.0 else df.where(hashed < F.lit(int(-(2**63) + share * 2**64)))
    return few.orderBy(hashed, *df.columns).limit(rows)
