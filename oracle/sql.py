"""Assembly of oracle statements: ``v_<view>`` names in a body pull in the CTEs they need."""

from __future__ import annotations

import datetime as dt
import re

from spendscope.sources.testdata import EVENTS_DAY, FLAT, USAGE_DAY, duckdb_text

ORACLE: dict[str, str] = {}
_NAME = re.compile(r"\bv_(\w+)\b")

# Views kept as intermediate results: DuckDB 2.0 has an internal error when it inlines them into joins.
MATERIALIZED = {"env", "running0", "running"}

DERIVED: dict[str, str] = {
    "priced": """
SELECT u.*, u.usage_quantity * COALESCE(p.price_default, CAST(0 AS DECIMAL(18,6))) AS cost, p.price_default IS NOT NULL AS is_priced,
  COALESCE(u.cluster_id, u.warehouse_id, u.job_run_id, u.dlt_pipeline_id) AS resource_id,
  CASE WHEN u.sku_name LIKE '%ALL!_PURPOSE%' ESCAPE '!' THEN 'All Purpose Compute' WHEN u.sku_name LIKE '%JOBS%' THEN 'Jobs Compute' WHEN u.sku_name LIKE '%SQL%' THEN 'SQL Warehouse'
    WHEN u.sku_name LIKE '%DLT%' THEN 'Delta Live Tables' WHEN u.sku_name LIKE '%SERVING%' THEN 'Model Serving' ELSE 'Other' END AS product_category
FROM v_usage_flat u LEFT JOIN v_list_prices p ON u.sku_name = p.sku_name AND u.cloud = p.cloud
  AND u.usage_start_time >= p.price_start_time AND (p.price_end_time IS NULL OR u.usage_start_time < p.price_end_time)""",
    "jobs_ranked": """
SELECT *, row_number() OVER (PARTITION BY workspace_id, job_id ORDER BY change_time DESC, name DESC, creator_user_name DESC, run_as_user_name DESC, created_time DESC, delete_time DESC NULLS LAST) AS rn FROM v_jobs""",
    "jobs_latest": "SELECT * FROM v_jobs_ranked WHERE rn = 1 AND delete_time IS NULL",
    "pipelines_ranked": """
SELECT *, row_number() OVER (PARTITION BY workspace_id, pipeline_id ORDER BY change_time DESC, name DESC, creator_user_name DESC, run_as_user_name DESC, channel DESC, edition DESC, trigger_kind DESC NULLS LAST, created_time DESC, delete_time DESC NULLS LAST) AS rn FROM v_pipelines""",
    "pipelines_latest": "SELECT * FROM v_pipelines_ranked WHERE rn = 1 AND delete_time IS NULL",
}


def _text(name: str) -> str:
    return DERIVED[name] if name in DERIVED else duckdb_text(name)


def _needed(body: str, order: list[str]) -> None:
    for name in _NAME.findall(body):
        if name in order or (name not in DERIVED and name not in FLAT):
            continue
        _needed(_text(name), order)
        order.append(name)


def oracle(key: str, body: str) -> None:
    """Register ``body`` under ``key``, with its views as CTEs."""
    order: list[str] = []
    _needed(body, order)
    ctes = ",\n".join(f"v_{n} AS {'MATERIALIZED ' if n in MATERIALIZED else ''}({_text(n).strip()})" for n in order)
    stmt = body.strip()
    if ctes and stmt.upper().startswith("WITH RECURSIVE "):
        stmt = f"WITH RECURSIVE {ctes},\n{stmt[15:]}"
    elif ctes and stmt.upper().startswith("WITH "):
        stmt = f"WITH {ctes},\n{stmt[5:]}"
    elif ctes:
        stmt = f"WITH {ctes}\n{stmt}"
    ORACLE[key] = stmt


def r(x: str, places: int) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(28,10)), {places}) AS DOUBLE)"


def pct(part: str, whole: str, places: int = 1) -> str:
    return f"COALESCE({r(f'CAST({part} AS DOUBLE) * 100 / NULLIF(CAST({whole} AS DOUBLE), 0)', places)}, 0.0)"


def change(new: str, old: str, places: int = 1) -> str:
    n, o = f"CAST({new} AS DOUBLE)", f"CAST({old} AS DOUBLE)"
    return f"COALESCE({r(f'({n} - {o}) * 100 / NULLIF({o}, 0)', places)}, 0.0)"


def day(back: int = 0) -> str:
    return f"DATE '{USAGE_DAY - dt.timedelta(days=back)}'"


def eday(back: int = 0) -> str:
    return f"DATE '{EVENTS_DAY - dt.timedelta(days=back)}'"


def within(days: int, col: str = "usage_date") -> str:
    return f"{col} BETWEEN {day(days)} AND {day()}"


def ts_within(days: int, col: str) -> str:
    return f"{col} >= TIMESTAMP '{USAGE_DAY - dt.timedelta(days=days)}' AND {col} < TIMESTAMP '{USAGE_DAY + dt.timedelta(days=1)}'"


def ets_within(days: int, col: str) -> str:
    return f"{col} >= TIMESTAMP '{EVENTS_DAY - dt.timedelta(days=days)}' AND {col} < TIMESTAMP '{EVENTS_DAY + dt.timedelta(days=1)}'"


UNITS = f"{r('SUM(usage_quantity)', 2)} AS units"
COST = f"{r('SUM(cost)', 2)} AS cost"
MINUTES = "(epoch(period_end_time) - epoch(period_start_time)) / 60.0"
