"""Reference SQL for DuckDB, one statement per report, over the generated test tables."""

from oracle import (  # noqa: F401
    activity_sql,
    anomaly_sql,
    cost_sql,
    executive_sql,
    inputs_sql,
    operations_sql,
    streams_sql,
)
from oracle.sql import ORACLE

__all__ = ["ORACLE"]
