"""Partitioned tables that are replaced as a whole or not at all.

Rows lie below ``data`` by partition and load; each load is new files beside the old ones. Which load counts in which
partition is said by a small table below ``live``, one folder per version, and the newest complete version is what
readers see. Its marker file is written last, by Spark's commit: a load that fails anywhere before leaves the table as
it was, and its files are never read. One writer at a time; readers need no lock.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from spendscope.sources.sinks import check_unique, matching, upsert

LOAD, SCHEMA = "load", "table_schema"


@dataclass(frozen=True)
class LiveTable:
    spark: SparkSession
    path: str
    partitions: tuple[str, ...]
    keys: tuple[str, ...]  # include the partition columns, so that the rows of a key stay in one partition

    def __post_init__(self) -> None:
        if not set(self.partitions) <= set(self.keys):
            raise ValueError("the partition columns must be among the keys")

    def version(self) -> int | None:
        """The newest complete version."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        marks = hadoop.Path(f"{self.path}/live/*/_SUCCESS")
        found = marks.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(marks)
        return max((int(f.getPath().getParent().getName()) for f in found or ()), default=None)

    def live(self, version: int | None = None) -> DataFrame:
        """Partition columns, the load that counts there, and the columns of the version."""
        number = self.version() if version is None else version
        if number is None:
            raise ValueError(f"{self.path} has no complete version")
        return self.spark.read.parquet(f"{self.path}/live/{number}")

    def _schema(self, version: int | None) -> StructType:
        text = self.live(version).select(SCHEMA).first()
        if text is None:
            raise ValueError(f"{self.path} has no partitions")
        return StructType.fromJson(json.loads(text[0]))

    def read(self, version: int | None = None, within: DataFrame | None = None) -> DataFrame:
        """The rows of a version; those of the partitions in ``within`` only, of which the other files are not opened."""
        live = self.live(version)
        if within is not None:
            live = live.alias("t").join(within.distinct().alias("s"), matching(self.partitions, "t", "s"), "left_semi")
        schema = self._schema(version)
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/data")
        # Plain equality prunes folders; NULL partition values have none, so they are matched beside it.
        some_null = F.lit(False)
        for p in self.partitions:
            some_null = some_null | F.col(p).isNull()
        on = [*self.partitions, LOAD]
        plain = rows.join(live.where(~some_null), on, "left_semi")
        rest = rows.where(some_null).alias("t").join(live.where(some_null).alias("s"), matching(on, "t", "s"), "left_semi")
        names = [c for c in schema.names if c != LOAD]
        return plain.select(*names).unionByName(rest.select(*names))

    def write(self, rows: DataFrame, touched: DataFrame | None = None) -> None:
        """Publishes ``rows`` as the content of the partitions in ``touched``; of the whole table without it.

        A partition that is touched and gets no rows is empty from then on.
        """
        before = self.version()
        load = uuid.uuid4().hex
        (
            rows.withColumn(LOAD, F.lit(load)).hint("rebalance", *self.partitions)
            .write.mode("append").partitionBy(*self.partitions, LOAD).parquet(f"{self.path}/data")
        )
        schema = StructType([*rows.schema.fields, StructField(LOAD, StringType())])
        if before is None or touched is None:
            written = self.spark.read.schema(schema).parquet(f"{self.path}/data")
            new = written.where(F.col(LOAD) == load).select(*self.partitions).distinct().withColumn(LOAD, F.lit(load))
        else:
            gone = touched.distinct()
            old = self.live(before).alias("t").join(gone.alias("s"), matching(self.partitions, "t", "s"), "left_anti")
            new = old.select(*self.partitions, LOAD).unionByName(gone.withColumn(LOAD, F.lit(load)))
        new.withColumn(SCHEMA, F.lit(schema.json())).coalesce(1).write.parquet(f"{self.path}/live/{0 if before is None else before + 1}")

    def upsert(self, source: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> None:
        """Replaces and adds rows by key; only partitions that ``source`` touches are read and written.

        ``change`` maps the stored rows of these partitions and the source to what shall stand there, instead.
        """
        source = source.persist()
        try:
            check_unique(source, self.keys)
            touched = source.select(*self.partitions).distinct()
            stored = self.read(within=touched)
            self.write(change(stored, source) if change else upsert(stored, source, self.keys), touched)
        finally:
            source.unpersist()

    def vacuum(self, keep: int = 2) -> None:
        """Deletes what none of the newest ``keep`` versions reads. Readers of older versions lose their files."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        newest = self.version()
        if newest is None:
            return
        fs = hadoop.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        versions = range(max(0, newest - keep + 1), newest + 1)
        used: set[str] = set()
        for v in versions:
            used |= {r[LOAD] for r in self.live(v).select(LOAD).distinct().collect()}
        depth = "/*" * len(self.partitions)
        for status in fs.globStatus(hadoop.Path(f"{self.path}/data{depth}/{LOAD}=*")) or ():
            if status.getPath().getName().removeprefix(f"{LOAD}=") not in used:
                fs.delete(status.getPath(), True)
        for status in fs.globStatus(hadoop.Path(f"{self.path}/live/*")) or ():
            name = status.getPath().getName()
            if name.isdigit() and int(name) < versions[0]:
                fs.delete(status.getPath(), True)
