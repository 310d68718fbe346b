"""Registered queries against their DuckDB statements; ORACLE_ALL=1 runs every one."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from oracle import ORACLE
from spendscope.plans import REPORTS
from tools.check_oracle import compare, duck

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "cost_summary", "cost_by_tag_env", "spike_resources", "warehouse_session", "tag_keys", "pareto", "annual_forecast", "savings_opportunities",
    "job_health", "cluster_sizing", "pipeline_sizing", "user_cost_attribution", "top_expensive_queries", "user_classes", "latency_percentiles",
    "principal_summary", "permission_edges", "governance_summary", "job_report", "serving_summary", "catalog_summary", "health_summary",
    "private_endpoints", "marketplace_summary", "cloud_summary", "running_anomalies", "alert_report", "baseline_zscore", "join_alert_context",
    "request_rate_violations", "failure_ban_candidates", "ingest_gcp_costs", "upsert_cloud_costs", "read_permissions", "dq_validate", "stream_sessions",
)
NO_SQL = {"iforest_train", "iforest_score", "resource_anomalies"}


def test_every_query_has_an_oracle_but_the_forest():
    assert set(REPORTS) - set(ORACLE) == NO_SQL and set(REPORTS) <= set(queries()) and set(ORACLE) <= set(oracle_sql())


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["usage_date", "product_category", "units", "cost"] and df.count() > 0


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
@pytest.mark.parametrize("name", sorted(ORACLE) if os.environ.get("ORACLE_ALL") else SAMPLE)
def test_matches_duckdb(spark, con, name):
    df = queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(oracle_sql()[name])
    assert compare(df.columns, rows, [d[0] for d in cur.description], cur.fetchall()) is None
