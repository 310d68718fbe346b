"""Spend, usage and governance analytics for a data platform, as Spark DataFrames."""

from spendscope.context import Ctx
from spendscope.sources.catalog import Catalog

__all__ = ["Catalog", "Ctx"]
