"""Logical table names resolved to where the data is; absent inputs, drifting columns, fallbacks."""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendscope.sources.schemas import SCHEMAS

# Error conditions that mean "this input is not there for us", as opposed to a broken query.
_ABSENT = (
    "TABLE_OR_VIEW_NOT_FOUND",
    "SCHEMA_NOT_FOUND",
    "PATH_NOT_FOUND",
    "UNRESOLVED_COLUMN",
    "INSUFFICIENT_PERMISSIONS",
    "UNABLE_TO_INFER_SCHEMA",
)

Location = str | Callable[[SparkSession], DataFrame]


class Catalog:
    """Maps ``area.table`` names to parquet folders, catalog tables or view-building functions.

    A string location with a slash is a parquet path, any other string a table name. Names without an
    entry resolve through ``areas`` (area -> schema or folder), then to ``root/area/table``.
    """

    def __init__(
        self,
        spark: SparkSession,
        locations: Mapping[str, Location] | None = None,
        areas: Mapping[str, str] | None = None,
        root: str | None = None,
        streams: Mapping[str, Callable[[SparkSession], DataFrame]] | None = None,
    ):
        self._spark = spark
        self._locations = dict(locations or {})
        self._areas = dict(areas or {})
        self._root = root
        self._streams = dict(streams or {})

    def resolve(self, name: str) -> Location:
        if name in self._locations:
            return self._locations[name]
        area, _, table = name.partition(".")
        if area in self._areas:
            base = self._areas[area]
            return posixpath.join(base, table) if "/" in base else f"{base}.{table}"
        return posixpath.join(self._root, area, table) if self._root else name

    def names(self) -> list[str]:
        """The logical tables with an entry of their own."""
        return sorted(self._locations)

    def table(self, name: str, optional: bool = False) -> DataFrame:
        """The frame behind ``name``; when ``optional``, an absent input is an empty typed frame."""
        where = self.resolve(name)
        try:
            if callable(where):
                return where(self._spark)
            if "/" in where:
                return self._spark.read.parquet(where)
            return self._spark.table(where)
        except AnalysisException as err:
            if not optional or not any(c in (err.getCondition() or str(err)) for c in _ABSENT):
                raise
            return empty(self._spark, SCHEMAS[name])

    def stream(self, name: str) -> DataFrame:
        """The same table as a stream: its registered stream, else new parquet files of its folder."""
        if name in self._streams:
            return self._streams[name](self._spark)
        return self._spark.readStream.schema(self.table(name).schema).parquet(self.resolve(name))


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    """No rows of the given schema, without a Python stage."""
    return spark.range(0).select(F.from_json(F.lit("{}"), ddl).alias("r")).select("r.*")


def first_col(df: DataFrame, *names: str, default: Column | str | None = "") -> Column:
    """Value of the first non-null column among those of ``names`` that exist in ``df``."""
    present = [F.col(n) for n in names if n in df.columns]
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(*present, fallback)


def first_nonempty(*frames: DataFrame) -> DataFrame:
    """The first frame that has a row, else the last one. Looks at one row per frame."""
    for df in frames[:-1]:
        if not df.isEmpty():
            return df
    return frames[-1]
