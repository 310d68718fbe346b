"""Named reports: functions from a context to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from spendscope.context import Ctx

Report = Callable[[Ctx], DataFrame]

REPORTS: dict[str, Report] = {}


def report(name: str) -> Callable[[Report], Report]:
    def add(fn: Report) -> Report:
        REPORTS[name] = fn
        return fn

    return add
