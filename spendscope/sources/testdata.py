"""The logical input tables as views over the generated test tables.

``FLAT`` holds one SELECT per logical table, in SQL that Spark and DuckDB both run; ``{name}`` stands
for a generated table. The Spark side wraps the flat columns into the structs and maps of the logical
schema, so that reports read the same column paths as on a real platform.
"""

from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendscope.context import Ctx
from spendscope.sources.catalog import Catalog

USAGE_DAY = dt.date(2001, 8, 1)
EVENTS_DAY = dt.date(2024, 1, 31)

# Base price per SKU and unit; prices rose by a tenth in 1999. The serving SKU has no price.
_BASE_PRICES = {
    "JOBS_COMPUTE": "0.15", "PREMIUM_ALL_PURPOSE_COMPUTE": "0.70", "PRO_SQL": "0.55", "DLT_PRO_COMPUTE": "0.25", "SERVERLESS_SQL": "0.70",
    "SERVERLESS_SQL_FAST": "0.90",
}


def _price_rows() -> str:
    windows = (("TIMESTAMP '1995-01-01 00:00:00'", "TIMESTAMP '1999-01-01 00:00:00'", "1.0"),
               ("TIMESTAMP '1999-01-01 00:00:00'", "CAST(NULL AS TIMESTAMP)", "1.1"))
    return ", ".join(
        f"('{sku}', '{cloud}', {start}, {end}, CAST({Decimal(base) * Decimal(rise)} AS DECIMAL(18,6)))"
        for sku, base in _BASE_PRICES.items() for cloud in ("AWS", "AZURE", "GCP") for start, end, rise in windows
    )


FLAT: dict[str, str] = {
    "workspaces": """
SELECT concat('ws-', n.n_nationkey) AS workspace_id,
  concat(CASE n.n_regionkey WHEN 1 THEN 'uat' WHEN 2 THEN 'test' WHEN 3 THEN 'dev' ELSE 'prod' END, '-', lower(replace(n.n_name, '_', '-'))) AS workspace_name,
  concat('https://ws-', n.n_nationkey, CASE n.n_nationkey % 3 WHEN 0 THEN '.aws' WHEN 1 THEN '.azure' ELSE '' END, '.example.net') AS workspace_url, 'RUNNING' AS workspace_status,
  CASE WHEN n.n_nationkey % 5 = 4 THEN '' ELSE CASE n.n_regionkey % 3 WHEN 0 THEN 'AWS' WHEN 1 THEN 'AZURE' ELSE 'GCP' END END AS cloud, r.r_name AS region,
  concat('sub-', n.n_nationkey % 4) AS subscription_id, concat('RG-', n.n_nationkey % 6) AS resource_group
FROM {nation} n JOIN {region} r ON n.n_regionkey = r.r_regionkey""",
    # So that every rule over spend fires: five times the use on the last day, a SKU that began in the last week, and from
    # June on one pipeline with daily rows under the same tags.
    "usage_flat": """
SELECT concat('r-', l.l_orderkey, '-', l.l_linenumber, '-', l.l_partkey) AS record_id,
  CASE WHEN (p.p_type = 'MEDIUM' AND l.l_suppkey % 2 = 0 AND l.l_shipdate >= DATE '2001-06-01') THEN 'ws-2' WHEN p.p_type = 'ECONOMY' THEN concat('ws-', (o.o_custkey % 200) % 25) ELSE concat('ws-', s.s_nationkey) END AS workspace_id,
  CASE p.p_type WHEN 'ECONOMY' THEN 'JOBS_COMPUTE' WHEN 'STANDARD' THEN 'PREMIUM_ALL_PURPOSE_COMPUTE' WHEN 'SMALL' THEN 'PRO_SQL'
    WHEN 'MEDIUM' THEN 'DLT_PRO_COMPUTE' WHEN 'LARGE' THEN CASE WHEN l.l_shipdate >= DATE '2001-07-26' AND l.l_suppkey % 2 = 0 THEN 'SERVERLESS_SQL_FAST' ELSE 'SERVERLESS_SQL' END ELSE 'FOUNDATION_MODEL_SERVING' END AS sku_name,
  CASE l.l_partkey % 3 WHEN 0 THEN 'AWS' WHEN 1 THEN 'AZURE' ELSE 'GCP' END AS cloud,
  l.l_shipdate + INTERVAL '1' HOUR * CAST(l.l_partkey % 24 AS INT) AS usage_start_time,
  l.l_shipdate + INTERVAL '1' HOUR * CAST(l.l_partkey % 24 AS INT) + INTERVAL '1' MINUTE * CAST(10 + l.l_suppkey % 171 AS INT) AS usage_end_time,
  CAST(l.l_shipdate AS DATE) AS usage_date, CAST(l.l_quantity * CASE WHEN CAST(l.l_shipdate AS DATE) = DATE '2001-08-01' THEN 5 ELSE 1 END AS DECIMAL(18,4)) AS usage_quantity,
  CASE WHEN l.l_linenumber = 7 THEN 'NETWORK_BYTE' WHEN l.l_linenumber = 6 THEN 'STORAGE_SPACE' ELSE 'COMPUTE_TIME' END AS usage_type,
  CASE p.p_type WHEN 'ECONOMY' THEN 'JOBS' WHEN 'STANDARD' THEN 'ALL_PURPOSE' WHEN 'SMALL' THEN 'SQL' WHEN 'MEDIUM' THEN 'DLT'
    WHEN 'LARGE' THEN 'SQL' ELSE 'MODEL_SERVING' END AS billing_origin_product,
  CASE WHEN p.p_type = 'STANDARD' THEN concat('cls-', l.l_suppkey % 50) END AS cluster_id,
  CASE WHEN p.p_type IN ('SMALL', 'LARGE') THEN concat('wh-', l.l_suppkey % 20) END AS warehouse_id,
  CASE WHEN p.p_type = 'ECONOMY' THEN concat('job-', o.o_custkey % 200) END AS job_id,
  CASE WHEN p.p_type = 'ECONOMY' THEN concat('run-', l.l_orderkey) END AS job_run_id,
  CASE WHEN (p.p_type = 'MEDIUM' AND l.l_suppkey % 2 = 0 AND l.l_shipdate >= DATE '2001-06-01') THEN 'dlt-2' WHEN p.p_type = 'MEDIUM' THEN concat('dlt-', l.l_partkey % 40) END AS dlt_pipeline_id,
  CASE WHEN p.p_type = 'PROMO' THEN concat('ep-', l.l_partkey % 25) END AS endpoint_name,
  concat('user', o.o_custkey % 150, '@example.com') AS run_as,
  CASE WHEN (p.p_type = 'MEDIUM' AND l.l_suppkey % 2 = 0 AND l.l_shipdate >= DATE '2001-06-01') THEN 'STEADY' WHEN o.o_custkey % 5 <> 0 THEN c.c_mktsegment END AS tag_team,
  CASE WHEN l.l_partkey % 4 = 0 AND NOT (p.p_type = 'MEDIUM' AND l.l_suppkey % 2 = 0 AND l.l_shipdate >= DATE '2001-06-01') THEN p.p_brand END AS tag_product_name,
  CASE WHEN l.l_partkey % 4 = 1 AND NOT (p.p_type = 'MEDIUM' AND l.l_suppkey % 2 = 0 AND l.l_shipdate >= DATE '2001-06-01') THEN p.p_brand END AS tag_product,
  CASE WHEN (p.p_type = 'MEDIUM' AND l.l_suppkey % 2 = 0 AND l.l_shipdate >= DATE '2001-06-01') THEN 'prod' ELSE CASE o.o_custkey % 4 WHEN 0 THEN 'prod' WHEN 1 THEN 'dev' WHEN 2 THEN 'uat' END END AS tag_env
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey""",
    "list_prices": f"SELECT * FROM (VALUES {_price_rows()}) AS p(sku_name, cloud, price_start_time, price_end_time, price_default)",
    "jobs": """
SELECT concat('ws-', (c_custkey % 200) % 25) AS workspace_id, concat('job-', c_custkey % 200) AS job_id,
  concat('etl-', lower(c_mktsegment), '-', c_custkey % 200) AS name, concat('user', c_custkey % 150, '@example.com') AS creator_user_name,
  concat('user', c_custkey % 97, '@example.com') AS run_as_user_name,
  CASE c_custkey % 3 WHEN 0 THEN 'prod' WHEN 1 THEN 'staging' ELSE 'dev' END AS tag_env,
  '0 0 8 * * ?' AS cron, CASE WHEN c_custkey % 7 = 0 THEN 'PAUSED' ELSE 'UNPAUSED' END AS pause_status,
  TIMESTAMP '1995-01-01 00:00:00' + INTERVAL '1' DAY * CAST(c_custkey % 200 AS INT) AS created_time,
  TIMESTAMP '1995-01-01 00:00:00' + INTERVAL '1' DAY * CAST(c_custkey % 1500 AS INT) AS change_time,
  CASE WHEN c_custkey % 13 = 0 THEN TIMESTAMP '1995-01-01 00:00:00' + INTERVAL '1' DAY * CAST(c_custkey % 1500 AS INT) END AS delete_time
FROM {customer}""",
    "job_runs": """
SELECT concat('ws-', (o_custkey % 200) % 25) AS workspace_id, concat('job-', o_custkey % 200) AS job_id, concat('run-', o_orderkey) AS run_id,
  o_orderdate + INTERVAL '1' HOUR * CAST(o_orderkey % 24 AS INT) AS period_start_time,
  o_orderdate + INTERVAL '1' HOUR * CAST(o_orderkey % 24 AS INT) + INTERVAL '1' MINUTE * CAST(2 + o_orderkey % 239 AS INT) AS period_end_time,
  CASE WHEN o_orderstatus = 'F' THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'TIMED_OUT' WHEN '2-HIGH' THEN 'CANCELLED' ELSE 'FAILED' END
    WHEN o_orderkey % 50 = 0 THEN NULL ELSE 'SUCCEEDED' END AS result_state,
  'JOB_RUN' AS run_type, CASE WHEN o_orderstatus = 'F' THEN 'RUN_EXECUTION_ERROR' END AS termination_code, concat('task-', o_orderkey % 4) AS task_key
FROM {orders}""",
    "job_tasks": """
SELECT concat('ws-', (o_custkey % 200) % 25) AS workspace_id, concat('job-', o_custkey % 200) AS job_id, concat('task-', o_orderkey % 4) AS task_key,
  o_orderdate AS change_time, CASE WHEN o_orderkey % 37 = 0 THEN o_orderdate END AS delete_time
FROM {orders}""",
    "pipelines": """
SELECT concat('ws-', (p_partkey % 40) % 25) AS workspace_id, concat('dlt-', p_partkey % 40) AS pipeline_id,
  concat('flow-', lower(p_type), '-', p_partkey % 40) AS name, concat('user', p_partkey % 150, '@example.com') AS creator_user_name,
  concat('user', p_partkey % 97, '@example.com') AS run_as_user_name,
  CASE p_partkey % 2 WHEN 0 THEN 'CURRENT' ELSE 'PREVIEW' END AS channel,
  CASE p_partkey % 3 WHEN 0 THEN 'CORE' WHEN 1 THEN 'PRO' ELSE 'ADVANCED' END AS edition,
  CASE p_partkey % 5 WHEN 0 THEN 'CONTINUOUS' WHEN 1 THEN 'CRON' WHEN 2 THEN 'FILE_ARRIVAL' WHEN 3 THEN 'MANUAL' END AS trigger_kind,
  TIMESTAMP '1995-01-01 00:00:00' + INTERVAL '1' DAY * CAST(p_partkey % 40 AS INT) AS created_time,
  TIMESTAMP '1995-01-01 00:00:00' + INTERVAL '1' DAY * CAST(p_partkey % 1500 AS INT) AS change_time,
  CASE WHEN p_partkey % 13 = 0 THEN TIMESTAMP '1995-01-01 00:00:00' + INTERVAL '1' DAY * CAST(p_partkey % 1500 AS INT) END AS delete_time
FROM {part} WHERE p_partkey % 40 <> 7""",
    "pipeline_updates": """
SELECT concat('ws-', (l.l_partkey % 40) % 25) AS workspace_id, concat('dlt-', l.l_partkey % 40) AS pipeline_id,
  concat('upd-', l.l_orderkey, '-', l.l_linenumber) AS update_id,
  CASE l.l_orderkey % 10 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'CANCELED' WHEN 2 THEN NULL ELSE 'COMPLETED' END AS result_state,
  l.l_shipdate + INTERVAL '1' HOUR * CAST(l.l_partkey % 24 AS INT) AS period_start_time,
  CASE WHEN l.l_orderkey % 60 <> 3 THEN l.l_shipdate + INTERVAL '1' HOUR * CAST(l.l_partkey % 24 AS INT) + INTERVAL '1' MINUTE * CAST(5 + l.l_suppkey % 111 AS INT) END AS period_end_time
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey WHERE p.p_type = 'MEDIUM'""",
    "clusters": """
SELECT concat('cls-', s_suppkey % 50) AS cluster_id, concat(CASE s_suppkey % 4 WHEN 0 THEN 'prod' WHEN 1 THEN 'nonprod' WHEN 2 THEN 'qa' ELSE 'adhoc' END, '-cluster-', s_suppkey) AS cluster_name,
  concat('ws-', s_nationkey) AS workspace_id, concat('user', s_suppkey % 150, '@example.com') AS owned_by,
  CASE WHEN s_suppkey % 9 = 0 THEN 'JOB' WHEN s_suppkey % 10 = 0 THEN NULL ELSE 'UI' END AS cluster_source,
  concat(12 + s_suppkey % 4, '.3.x') AS runtime_version, concat('node-', s_suppkey % 5) AS driver_node_type, concat('node-', s_suppkey % 9) AS worker_node_type,
  CAST(1 + s_suppkey % 10 AS BIGINT) AS min_autoscale_workers, CAST(1 + s_suppkey % 10 + s_suppkey % 3 AS BIGINT) AS max_autoscale_workers,
  CAST((s_suppkey % 4) * 60 AS BIGINT) AS auto_termination_minutes,
  TIMESTAMP '2001-01-01 00:00:00' + INTERVAL '1' DAY * CAST(s_suppkey % 200 AS INT) AS change_time,
  CASE WHEN s_suppkey % 11 = 0 THEN TIMESTAMP '2001-07-30 00:00:00' END AS delete_time
FROM {supplier}""",
    "warehouses": """
SELECT concat('wh-', s_suppkey % 20) AS warehouse_id, concat('bi-', s_suppkey) AS warehouse_name, concat('ws-', s_nationkey) AS workspace_id,
  CASE s_suppkey % 3 WHEN 0 THEN 'PRO' WHEN 1 THEN 'CLASSIC' ELSE 'SERVERLESS' END AS warehouse_type,
  CASE s_suppkey % 4 WHEN 0 THEN 'Small' WHEN 1 THEN 'Medium' WHEN 2 THEN 'Large' ELSE 'X-Large' END AS warehouse_size,
  CAST(1 + s_suppkey % 2 AS INT) AS min_clusters, CAST(2 + s_suppkey % 5 AS INT) AS max_clusters, CAST((s_suppkey % 3) * 10 AS INT) AS auto_stop_minutes,
  TIMESTAMP '2001-01-01 00:00:00' + INTERVAL '1' DAY * CAST(s_suppkey % 200 AS INT) AS change_time,
  CASE WHEN s_suppkey % 17 = 0 THEN TIMESTAMP '2001-07-30 00:00:00' END AS delete_time
FROM {supplier}""",
    "node_types": """
SELECT DISTINCT concat('node-', s_suppkey % 8) AS node_type_id, CAST(4 * (1 + s_suppkey % 8) AS INT) AS num_cpus,
  CAST(15000 * (1 + s_suppkey % 8) AS BIGINT) AS memory_mb, CAST(CASE WHEN s_suppkey % 8 = 7 THEN 2 END AS INT) AS num_gpus,
  CASE WHEN s_suppkey % 8 = 7 THEN 'A10' END AS gpu_name, s_suppkey % 8 = 0 AS is_deprecated,
  CASE WHEN s_suppkey % 8 = 7 THEN 'GPU' ELSE 'General' END AS category
FROM {supplier}""",
    "node_timeline": """
SELECT concat('cls-', l_suppkey % 50) AS cluster_id, concat('ws-', l_suppkey % 25) AS workspace_id,
  concat('n-', l_suppkey % 50, '-', l_linenumber) AS node_id, l_linenumber = 1 AS is_driver,
  l_shipdate + INTERVAL '1' HOUR * CAST(l_partkey % 24 AS INT) AS start_time, CAST(l_quantity * 1.8 AS DECIMAL(9,3)) AS cpu_user_percent,
  CAST(l_tax * 100 AS DECIMAL(9,3)) AS cpu_system_percent, CAST(20 + l_discount * 700 AS DECIMAL(9,3)) AS mem_used_percent,
  CAST(3600 * (1 + l_linenumber) AS INT) AS uptime_seconds, CAST(CASE WHEN l_partkey % 20 = 0 THEN 0 ELSE 4 + l_linenumber END AS INT) AS num_task_slots,
  CAST(l_quantity / 10 AS DECIMAL(9,3)) AS avg_num_running_tasks, CAST(l_discount * 50 AS DECIMAL(9,3)) AS avg_num_queued_tasks
FROM {lineitem}""",
    "cluster_events": """
SELECT concat('cls-', user_id % 50) AS cluster_id, concat('ws-', user_id % 25) AS workspace_id, ts AS event_time,
  CASE event_type WHEN 'error' THEN 'DRIVER_UNAVAILABLE' WHEN 'click' THEN 'RESIZING' WHEN 'purchase' THEN 'UPSIZE_COMPLETED' WHEN 'signup' THEN 'RUNNING' ELSE 'TERMINATING' END AS event_type,
  concat('e-', event_id) AS event_ref
FROM {events}""",
    "warehouse_events": """
SELECT concat('wh-', user_id % 20) AS warehouse_id, ts AS event_time, CAST(1 + event_id % 4 AS INT) AS cluster_count,
  CASE event_type WHEN 'signup' THEN 'STARTING' WHEN 'error' THEN 'STOPPED' WHEN 'view' THEN 'SCALED_UP' ELSE 'RUNNING' END AS event_type
FROM {events}""",
    "audit": """
SELECT concat('ws-', user_id % 25) AS workspace_id, CASE WHEN user_id % 13 = 5 THEN ts - INTERVAL '45' DAY ELSE ts END AS event_time,
  CAST(CASE WHEN user_id % 13 = 5 THEN ts - INTERVAL '45' DAY ELSE ts END AS DATE) AS event_date,
  CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN ' ' WHEN user_id % 10 = 0 THEN concat(1000 + user_id, '@9001') ELSE concat('user', user_id, '@example.com') END AS user_email,
  CASE event_type WHEN 'click' THEN 'notebook' WHEN 'view' THEN 'dashboards' WHEN 'purchase' THEN 'iamService' WHEN 'signup' THEN 'accounts' ELSE 'clusters' END AS service_name,
  CASE event_id % 9 WHEN 0 THEN 'createToken' WHEN 1 THEN 'revokeToken' WHEN 2 THEN 'addPrincipalToGroup' WHEN 3 THEN 'updateGroup' WHEN 4 THEN 'changePermissions'
    WHEN 5 THEN 'createServicePrincipal' WHEN 6 THEN 'login' WHEN 7 THEN 'runCommand' ELSE 'getTable' END AS action_name,
  concat('10.0.0.', user_id % 50) AS source_ip, CASE WHEN event_id % 41 = 0 THEN 'curl/8.0' WHEN event_id % 43 = 0 THEN '' ELSE 'Mozilla/5.0' END AS user_agent,
  CASE WHEN event_type = 'error' THEN 403 ELSE 200 END AS status_code, concat('e-', event_id) AS event_id,
  CASE WHEN event_id % 67 = 0 THEN NULL WHEN event_id % 61 = 0 THEN '{{"groupName": "gro'
    ELSE concat('{{"groupName": "group-', user_id % 12, '", "principal": {{"id": ', user_id, ', "kind": "', CASE WHEN event_id % 2 = 0 THEN 'user' ELSE 'group' END,
      '"}}, "changes": [{{"object": "cat-', event_id % 9, '", "level": ', CASE WHEN event_id % 5 = 0 THEN 'null' ELSE '"CAN_USE"' END, '}}]}}') END AS request_params
FROM {events}""",
    # One client sends a third of all requests, every other 2000 of the log in clumps of one second.
    "request_log": """
SELECT concat('q-', event_id) AS request_id, CASE WHEN event_id % 3 = 0 THEN '10.0.0.1' ELSE concat('10.0.1.', user_id % 50) END AS client,
  TIMESTAMP '2024-01-31 00:00:00' + INTERVAL '1' SECOND * CAST(CASE WHEN event_id % 3 = 0 AND CAST(floor(event_id / 2000.0) AS BIGINT) % 2 = 0 THEN floor(event_id / 500.0) * 200 ELSE floor(event_id * 0.4) END AS INT) AS event_time,
  CASE event_type WHEN 'click' THEN 'notebook' WHEN 'view' THEN 'dashboards' WHEN 'purchase' THEN 'iamService' WHEN 'signup' THEN 'accounts' ELSE 'clusters' END AS service_name,
  CASE WHEN event_type = 'error' THEN 403 ELSE 200 END AS status_code,
  CASE WHEN event_id % 59 = 0 THEN '{{"user-agent": "Moz' ELSE concat('{{', CASE WHEN event_id % 43 = 0 THEN '' ELSE concat('"user-agent": "', CASE WHEN event_id % 41 = 0 THEN 'curl/8.0' ELSE 'Mozilla/5.0' END, '", ') END,
    CASE WHEN event_id % 47 = 0 THEN '' ELSE '"accept": "*/*", ' END, '"host": "app"}}') END AS headers
FROM {events}""",
    "query_history": """
SELECT concat('stmt-', event_id) AS statement_id, concat('user', user_id, '@example.com') AS executed_by,
  CASE WHEN event_id % 6 = 0 THEN 'svc@example.com' ELSE concat('user', user_id, '@example.com') END AS executed_as,
  CASE WHEN event_id % 31 <> 0 THEN concat('wh-', user_id % 20) END AS warehouse_id,
  CASE event_type WHEN 'click' THEN 'SELECT' WHEN 'view' THEN 'SELECT' WHEN 'purchase' THEN 'INSERT' WHEN 'signup' THEN 'OTHER' ELSE 'MERGE' END AS statement_type,
  concat('SELECT * FROM t WHERE k = ', event_id) AS statement_text, ts AS start_time, CAST(event_id % 977 * 211 AS BIGINT) AS total_duration_ms,
  CAST(event_id % 1009 * 10485760 AS BIGINT) AS read_bytes, CAST(event_id % 1013 * 1000 AS BIGINT) AS read_rows,
  CASE WHEN event_type = 'error' THEN 'TABLE_OR_VIEW_NOT_FOUND' END AS error_message
FROM {events}""",
    "gateway_usage": """
SELECT concat('model-', event_id % 5) AS route_name, ts AS event_time, CASE WHEN event_id % 37 <> 0 THEN concat('user', user_id, '@example.com') END AS requester,
  CAST(100 + event_id % 7901 AS BIGINT) AS input_token_count, CAST(CASE WHEN event_type = 'error' THEN 0 ELSE 50 + event_id % 3947 END AS BIGINT) AS output_token_count,
  CAST(100 + event_id % 7901 + CASE WHEN event_type = 'error' THEN 0 ELSE 50 + event_id % 3947 END AS BIGINT) AS total_token_count,
  CAST(100 + event_id % 4903 AS DOUBLE) AS execution_duration_ms
FROM {events}""",
    "endpoint_usage": """
SELECT concat('ep-', event_id % 25) AS served_entity_name, ts AS request_time, CAST(event_id % 5003 AS BIGINT) AS total_token_count,
  CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code
FROM {events}""",
    "served_entities": """
SELECT DISTINCT concat('serve-', p_partkey % 27) AS endpoint_name, concat('ep-', p_partkey % 27) AS served_entity_name,
  CASE (p_partkey % 27) % 2 WHEN 0 THEN 'FOUNDATION_MODEL' ELSE 'CUSTOM_MODEL' END AS entity_type, concat('ws-', (p_partkey % 27) % 25) AS workspace_id
FROM {part} WHERE p_partkey % 27 <> 3""",
    "experiments": """
SELECT concat('exp-', s_suppkey) AS experiment_id, concat('/exp/', s_name) AS name, CASE WHEN s_suppkey % 9 = 0 THEN 'deleted' ELSE 'active' END AS lifecycle_stage,
  CAST(978307200000 + s_suppkey % 200 * 86400000 AS BIGINT) AS creation_time, CAST(985000000000 + s_suppkey % 200 * 86400000 AS BIGINT) AS last_update_time
FROM {supplier}""",
    "ml_runs": """
SELECT concat('exp-', o_custkey % 100) AS experiment_id, concat('mlrun-', o_orderkey) AS run_id,
  CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'FINISHED' ELSE 'RUNNING' END AS status, o_orderdate AS start_time,
  o_orderdate + INTERVAL '1' MINUTE * CAST(o_orderkey % 90 AS INT) AS end_time, concat('user', o_custkey % 150, '@example.com') AS user_id
FROM {orders}""",
    "ml_models": """
SELECT concat('main.ml.model_', s_suppkey) AS name, CAST(978307200000 + s_suppkey % 200 * 86400000 AS BIGINT) AS creation_timestamp,
  CAST(985000000000 + s_suppkey % 150 * 86400000 AS BIGINT) AS last_updated_timestamp, concat('user', s_suppkey % 150, '@example.com') AS user_id
FROM {supplier}""",
    "table_lineage": """
SELECT 'main' AS source_catalog, 'bronze' AS source_schema, concat('t', l_partkey % 60) AS source_table, 'main' AS target_catalog, 'silver' AS target_schema,
  concat('t', l_suppkey % 30) AS target_table, l_shipdate AS event_time
FROM {lineitem}""",
    "column_lineage": """
SELECT 'main' AS source_catalog, 'bronze' AS source_schema, concat('t', l_partkey % 60) AS source_table, concat('c', l_linenumber) AS source_column,
  'main' AS target_catalog, 'silver' AS target_schema, concat('t', l_suppkey % 30) AS target_table, concat('c', l_linenumber % 3) AS target_column, l_shipdate AS event_time
FROM {lineitem}""",
    "optimization_ops": """
SELECT 'main' AS catalog_name, concat('sch-', o_custkey % 25) AS schema_name, concat('t', o_custkey % 60) AS table_name,
  CASE o_orderkey % 3 WHEN 0 THEN 'OPTIMIZE' WHEN 1 THEN 'VACUUM' ELSE 'ZORDER' END AS operation_type,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 = 0 THEN 'FAILED' WHEN o_orderkey % 23 = 0 THEN 'RUNNING' ELSE 'SUCCEEDED' END AS operation_status,
  o_orderdate AS start_time, o_orderdate + INTERVAL '1' MINUTE * CAST(3 + o_orderkey % 43 AS INT) AS end_time, concat('op-', o_orderkey) AS operation_id
FROM {orders}""",
    "tables": """
SELECT CASE p_partkey % 7 WHEN 0 THEN 'system' WHEN 1 THEN 'samples' ELSE concat('cat-', p_partkey % 5) END AS table_catalog,
  CASE WHEN p_partkey % 11 = 0 THEN 'information_schema' ELSE concat('sch-', p_partkey % 23) END AS table_schema, concat('t', p_partkey) AS table_name,
  CASE p_partkey % 3 WHEN 0 THEN 'MANAGED' WHEN 1 THEN 'EXTERNAL' ELSE 'VIEW' END AS table_type,
  TIMESTAMP '2000-01-01 00:00:00' + INTERVAL '1' DAY * CAST(p_partkey % 400 AS INT) AS created
FROM {part}""",
    "cloud_costs": """
SELECT CASE n.n_regionkey % 3 WHEN 0 THEN 'aws' WHEN 1 THEN 'azure' ELSE 'gcp' END AS cloud_provider, concat('acct-', n.n_nationkey) AS account_id, n.n_name AS account_name,
  CAST(l.l_shipdate AS DATE) AS usage_date, concat('service-', p.p_type) AS service_name,
  CASE p.p_type WHEN 'ECONOMY' THEN 'Compute' WHEN 'STANDARD' THEN 'Storage' WHEN 'SMALL' THEN 'Database' WHEN 'MEDIUM' THEN 'Analytics' ELSE 'AI / ML' END AS service_category,
  p.p_brand AS sku_description, 'Hrs' AS usage_unit, CAST(l.l_quantity AS DECIMAL(18,4)) AS usage_quantity, CAST(p.p_retailprice AS DECIMAL(18,4)) AS unit_price,
  CAST(l.l_extendedprice AS DECIMAL(18,4)) AS cost_usd, CASE WHEN l.l_discount > 0.05 THEN 'RESERVED_1Y' ELSE 'ON_DEMAND' END AS pricing_model,
  r.r_name AS region, CASE WHEN l.l_linenumber = 7 THEN NULL ELSE concat('rg-', l.l_linenumber) END AS resource_group
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
JOIN {nation} n ON s.s_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey""",
    "azure_export": """
SELECT substr(CAST(CAST(l_shipdate AS DATE) AS VARCHAR(10)), 1, 10) AS usage_day, concat('sub-', l_suppkey % 4) AS subscription_id, concat('Service ', l_partkey % 6) AS service_name,
  concat('Category ', l_partkey % 3) AS service_category, concat('Meter ', l_partkey % 11) AS meter_name, 'Hrs' AS unit_of_measure,
  CASE WHEN l_linenumber = 7 THEN 0 ELSE l_quantity END AS usage_quantity, l_extendedprice AS cost, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE 'EUR' END AS currency,
  concat('loc-', l_suppkey % 5) AS resource_location, concat('rg-', l_linenumber) AS resource_group_name
FROM {lineitem}""",
    "aws_export": """
SELECT substr(CAST(CAST(l_shipdate AS DATE) AS VARCHAR(10)), 1, 10) AS usage_day,
  CASE l_partkey % 6 WHEN 0 THEN 'Amazon Elastic Compute Cloud' WHEN 1 THEN 'AWS Lambda' WHEN 2 THEN 'Amazon DynamoDB' WHEN 3 THEN 'Amazon Redshift' WHEN 4 THEN 'Amazon Bedrock' ELSE 'Amazon Polly' END AS service,
  concat('acct-', l_suppkey % 9) AS linked_account, concat('region-', l_suppkey % 4) AS region,
  CASE l_orderkey % 4 WHEN 0 THEN 'EU-SpotUsage:m5' WHEN 1 THEN 'HeavyUsage:m5' WHEN 2 THEN 'EUC1-PartialUpfront' ELSE 'BoxUsage:m5' END AS usage_type,
  CASE WHEN l_linenumber = 7 THEN 0 ELSE l_quantity END AS usage_quantity, l_extendedprice AS unblended_cost, 'USD' AS currency
FROM {lineitem}""",
    "gcp_export": """
SELECT concat('proj-', l_suppkey % 6) AS project_id, CASE WHEN l_suppkey % 6 <> 2 THEN concat('Project ', l_suppkey % 6) END AS project_name, l_shipdate AS usage_start_time,
  CASE l_partkey % 5 WHEN 0 THEN 'Compute Engine' WHEN 1 THEN 'Cloud Run' WHEN 2 THEN 'BigQuery' WHEN 3 THEN 'Vertex AI' ELSE 'Cloud Logging' END AS service_description,
  concat('SKU ', l_partkey % 7) AS sku_description, 'hour' AS pricing_unit, CAST(l_quantity AS DECIMAL(18,4)) AS usage_amount, CAST(l_extendedprice AS DECIMAL(18,4)) AS cost, 'USD' AS currency,
  CASE WHEN l_suppkey % 3 <> 0 THEN concat('r-', l_suppkey % 3) END AS location_region, CASE WHEN l_suppkey % 2 = 0 THEN 'eu' END AS location_name,
  CAST(CASE WHEN l_linenumber > 2 THEN -l_discount * 10 END AS DECIMAL(18,4)) AS credit_a, CAST(CASE WHEN l_linenumber > 4 THEN -l_tax END AS DECIMAL(18,4)) AS credit_b
FROM {lineitem}""",
    "user_permissions": """
SELECT concat(CASE WHEN c_custkey % 2 = 0 THEN 'User' ELSE 'user' END, c_custkey, '@example.com') AS email,
  CASE c_custkey % 4 WHEN 0 THEN concat('{{"tabs": ["cost", "query"], "workspaces": ["ws-', c_nationkey, '"], "tags": [{{"key": "Team", "value": "', c_mktsegment, '"}}]}}')
    WHEN 1 THEN concat('{{"tabs": ["executive"], "tags": [{{"Product": "', c_mktsegment, '"}}]}}') WHEN 2 THEN '{{}}' ELSE 'not json' END AS config,
  TIMESTAMP '2001-01-01 00:00:00' + INTERVAL '1' DAY * CAST(c_custkey % 200 AS INT) AS updated_at, 'admin@example.com' AS updated_by
FROM {customer}""",
    "users": """
SELECT DISTINCT concat('u-', c_custkey % 150) AS user_id, concat('user', c_custkey % 150, '@example.com') AS email, concat('old', c_custkey % 150, '@example.com') AS other_email,
  concat('User ', c_custkey % 150) AS display_name, (c_custkey % 150) % 17 <> 0 AS active, (c_custkey % 150) % 4 <> 0 AS email_is_primary
FROM {customer}""",
    "groups": """
SELECT DISTINCT concat('g-', c_custkey % 12) AS group_id, concat('group-', c_custkey % 12) AS group_name FROM {customer}""",
    "group_members": """
SELECT DISTINCT concat('group-', c_custkey % 12) AS group_name, concat('user', c_custkey % 150, '@example.com') AS member FROM {customer}""",
    "group_entitlements": """
SELECT DISTINCT concat('group-', c_custkey % 12) AS group_name, CASE c_custkey % 5 WHEN 0 THEN 'workspace-admin' WHEN 1 THEN 'allow-cluster-create'
  WHEN 2 THEN 'allow-instance-pool-create' WHEN 3 THEN 'sql-access' ELSE 'custom-power-user' END AS entitlement
FROM {customer}""",
    "workspace_assignments": """
SELECT DISTINCT concat('ws-', c_nationkey) AS workspace_id,
  CASE WHEN c_custkey % 3 = 0 THEN concat('group-', c_custkey % 12) END AS group_name,
  CASE WHEN c_custkey % 3 = 1 AND c_custkey % 7 = 0 THEN concat('sp-', c_custkey % 20) END AS service_principal_name,
  CASE WHEN c_custkey % 3 = 2 OR (c_custkey % 3 = 1 AND c_custkey % 7 <> 0) THEN concat('user', c_custkey % 150, '@example.com') END AS user_name,
  CASE WHEN c_custkey % 10 = 0 THEN 'ADMIN' ELSE 'USER' END AS permission
FROM {customer}""",
    "catalogs": """
SELECT DISTINCT CASE WHEN n_nationkey % 9 = 8 THEN '__internal' ELSE concat('cat-', n_nationkey % 9) END AS catalog_name FROM {nation}""",
    "catalog_privileges": """
SELECT CASE WHEN c_custkey % 29 = 0 THEN ' ' WHEN c_custkey % 3 = 0 THEN concat('GROUP-', c_custkey % 12) WHEN c_custkey % 5 = 0 THEN concat('u-', c_custkey % 150)
    ELSE concat('user', c_custkey % 170, '@example.com') END AS grantee,
  CASE WHEN c_custkey % 31 = 0 THEN '__internal' ELSE concat(' cat-', c_nationkey % 11) END AS catalog_name,
  CASE c_custkey % 4 WHEN 0 THEN 'USE_CATALOG' WHEN 1 THEN 'CREATE_SCHEMA' WHEN 2 THEN 'BROWSE' END AS privilege_type
FROM {customer}""",
    "schema_privileges": """
SELECT CASE WHEN c_custkey % 3 = 0 THEN concat('group-', c_custkey % 12) ELSE concat('user', c_custkey % 150, '@example.com') END AS grantee,
  concat('cat-', c_nationkey % 6) AS catalog_name, concat('sch-', c_nationkey) AS schema_name,
  CASE c_custkey % 4 WHEN 0 THEN 'SELECT' WHEN 1 THEN 'MODIFY' WHEN 2 THEN 'USE_SCHEMA' ELSE 'ALL_PRIVILEGES' END AS privilege_type
FROM {customer}""",
    "row_filters": """
SELECT concat('cat-', c_nationkey % 6) AS catalog_name, concat('sch-', c_nationkey) AS schema_name, concat('t', c_custkey) AS table_name, 'by_region' AS filter_name, 'region = current_region()' AS filter_body
FROM {customer} WHERE c_custkey % 50 = 0""",
    "column_masks": """
SELECT concat('cat-', c_nationkey % 6) AS catalog_name, concat('sch-', c_nationkey) AS schema_name, concat('t', c_custkey) AS table_name, 'email' AS column_name, 'mask_email' AS mask_name, 'sha2(email, 256)' AS mask_body
FROM {customer} WHERE c_custkey % 40 = 0""",
    "private_endpoint_rules": """
SELECT CASE WHEN n_nationkey % 8 = 7 THEN NULL ELSE concat('ws-', n_nationkey % 10) END AS workspace_id, concat('pe-', n_nationkey) AS endpoint_name, concat('id-', n_nationkey) AS private_endpoint_id, concat('res-', n_nationkey) AS resource_id,
  'blob' AS group_id, concat('pe-', n_nationkey, '.example.net') AS fqdn, CASE n_nationkey % 4 WHEN 0 THEN 'ESTABLISHED' WHEN 1 THEN 'PENDING' WHEN 2 THEN '' END AS state
FROM {nation}""",
    "dashboards": """
SELECT concat('dash-', s_suppkey) AS dashboard_id, concat('Board ', s_suppkey) AS name, concat('user', s_suppkey % 150, '@example.com') AS owner_username,
  TIMESTAMP '2023-01-01 00:00:00' + INTERVAL '1' DAY * CAST(s_suppkey % 300 AS INT) AS created_time, TIMESTAMP '2023-06-01 00:00:00' + INTERVAL '1' DAY * CAST(s_suppkey % 200 AS INT) AS updated_time
FROM {supplier}""",
    "dashboard_events": """
SELECT concat('ws-', user_id % 25) AS workspace_id, concat('dash-', event_id % 40) AS dashboard_id, CASE WHEN event_id % 5 <> 0 THEN concat('Board ', event_id % 40) WHEN event_id % 10 = 0 THEN '' END AS dashboard_name,
  event_type, CASE WHEN event_id % 53 <> 0 THEN concat('user', user_id, '@example.com') END AS user_id, ts AS event_time
FROM {events}""",
    "sql_alerts": """
SELECT concat('alert-', s_suppkey) AS alert_id, concat('Alert ', s_suppkey) AS name, CASE s_suppkey % 4 WHEN 0 THEN 'OK' WHEN 1 THEN 'TRIGGERED' WHEN 2 THEN '' END AS state
FROM {supplier}""",
    "listing_events": """
SELECT concat('lst-', event_id % 30) AS listing_id, concat('Listing ', event_id % 30) AS listing_name, CASE event_type WHEN 'view' THEN 'VIEW' WHEN 'click' THEN 'GET_DATA' ELSE 'REQUEST' END AS event_type,
  ts AS event_time, concat('ws-', user_id % 25) AS consumer_workspace_id, concat('e-', event_id) AS event_ref
FROM {events}""",
    "consumer_listings": """
SELECT concat('lst-', c_custkey) AS listing_id, concat('Listing ', c_custkey) AS listing_name, CASE WHEN c_custkey % 20 <> 0 THEN concat('Provider ', c_custkey % 20) END AS provider_name, 'INSTALLED' AS status,
  CASE c_custkey % 3 WHEN 0 THEN 'STANDARD' WHEN 1 THEN 'PERSONALIZED' END AS listing_type, TIMESTAMP '2023-01-01 00:00:00' + INTERVAL '1' DAY * CAST(c_custkey % 300 AS INT) AS installed_on, concat('cat_', c_custkey) AS installed_catalog
FROM {customer}""",
    "provider_listings": """
SELECT concat('own-', s_suppkey) AS listing_id, concat('Own listing ', s_suppkey) AS listing_name, 'PUBLISHED' AS status, 'STANDARD' AS listing_type,
  TIMESTAMP '2023-01-01 00:00:00' + INTERVAL '1' DAY * CAST(s_suppkey % 300 AS INT) AS created_at, TIMESTAMP '2023-06-01 00:00:00' + INTERVAL '1' DAY * CAST(s_suppkey % 200 AS INT) AS updated_at
FROM {supplier}""",
    "running_resources": """
SELECT CASE s_suppkey % 4 WHEN 0 THEN 'Cluster' WHEN 1 THEN 'SQL Warehouse' WHEN 2 THEN 'Job Run' ELSE 'DLT Pipeline' END AS service_type,
  CASE s_suppkey % 4 WHEN 0 THEN concat('cls-', s_suppkey % 50) WHEN 1 THEN concat('wh-', s_suppkey % 20) WHEN 2 THEN concat('run-', s_suppkey * 131) ELSE concat('dlt-', s_suppkey % 40) END AS resource_id,
  concat(CASE s_suppkey % 5 WHEN 0 THEN 'prod' WHEN 1 THEN 'nonprod' WHEN 2 THEN 'qa' WHEN 3 THEN 'uat' ELSE 'adhoc' END, '-', s_suppkey) AS name,
  concat('ws-', s_nationkey) AS workspace_id, CASE WHEN s_suppkey % 6 = 0 THEN 'production' END AS tag_environment,
  TIMESTAMP '2001-08-01 00:00:00' - INTERVAL '1' HOUR * CAST(s_suppkey % 100 AS INT) AS started_at
FROM {supplier}""",
}

# Tables as they arrive from outside: every rule for them is broken by some row.
FLAT |= {
    "landing_usage": """
SELECT concat('r-', l_orderkey, '-', l_linenumber, '-', l_partkey) AS record_id, CAST(l_shipdate AS DATE) AS usage_date,
  CASE WHEN l_partkey % 101 = 0 THEN 'ws 1' WHEN l_partkey % 103 = 0 THEN NULL ELSE concat('ws-', l_suppkey % 25) END AS workspace_id,
  CASE WHEN l_partkey % 107 = 0 THEN 'pro sql' ELSE 'PRO_SQL' END AS sku_name,
  CASE WHEN l_partkey % 109 = 0 THEN 'Team!' ELSE 'Team' END AS tag_key, CASE WHEN l_partkey % 113 = 0 THEN concat('a', chr(7)) WHEN l_partkey % 3 = 0 THEN 'core' END AS tag_value
FROM {lineitem}""",
    "landing_workspaces": """
SELECT concat('ws-', n_nationkey) AS workspace_id, CASE WHEN n_nationkey % 7 = 3 THEN 'sub 1' ELSE concat('sub-', n_nationkey % 4) END AS subscription_id,
  CASE WHEN n_nationkey % 5 = 1 THEN 'rg/1' WHEN n_nationkey % 11 = 2 THEN NULL ELSE concat('RG-', n_nationkey % 6) END AS resource_group
FROM {nation}""",
    "landing_tables": """
SELECT CASE WHEN p_partkey % 53 = 0 THEN 'bad name' ELSE concat('t', p_partkey) END AS table_name FROM {part}""",
    "landing_permissions": """
SELECT concat('user', c_custkey, '@example.com') AS email, CASE c_custkey % 7 WHEN 0 THEN 'not json' WHEN 1 THEN '{{"tabs": ["cost", "nope"]}}' WHEN 2 THEN '{{"workspaces": ["ws-1", "w s"]}}'
    WHEN 3 THEN '{{}}' ELSE '{{"tabs": ["cost"], "workspaces": ["ws-1"]}}' END AS config,
  TIMESTAMP '2001-01-01 00:00:00' AS updated_at, 'admin@example.com' AS updated_by
FROM {customer}""",
    "landing_settings": """
SELECT CASE WHEN c_custkey % 10 = 9 THEN concat('user', c_custkey) ELSE concat('user', c_custkey, '@example.com') END AS email,
  CASE c_custkey % 6 WHEN 0 THEN '20' WHEN 1 THEN '0.5' WHEN 2 THEN '101' WHEN 3 THEN 'often' WHEN 4 THEN '99.9' END AS threshold_pct
FROM {customer}""",
    "landing_prices": """
SELECT concat('SKU_', n_nationkey) AS sku_name, 'AWS' AS cloud, TIMESTAMP '1999-01-01 00:00:00' AS price_start_time,
  CASE n_nationkey % 5 WHEN 0 THEN NULL WHEN 1 THEN TIMESTAMP '2000-06-01 00:00:00' ELSE TIMESTAMP '2000-01-01 00:00:00' END AS price_end_time FROM {nation}
UNION ALL
SELECT concat('SKU_', n_nationkey), 'AWS', TIMESTAMP '2000-01-01 00:00:00', CASE WHEN n_nationkey % 9 = 4 THEN TIMESTAMP '1999-12-01 00:00:00' END FROM {nation}""",
}

_TABLE_REF = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def duckdb_text(name: str) -> str:
    """The flat view as DuckDB text, where the generated tables are views of their own name."""
    return FLAT[name].format_map(_Names())


class _Names(dict):
    def __missing__(self, key: str) -> str:
        return key


@lru_cache(maxsize=256)
def _read(spark: SparkSession, path: str) -> DataFrame:
    """Remembered so that a session infers each file's schema once."""
    return spark.read.parquet(path)


@lru_cache(maxsize=1024)
def _flat(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: _read(spark, f"{sf_dir}/{t}.parquet") for t in set(_TABLE_REF.findall(FLAT[name]))}
    df = spark.sql(FLAT[name], **tables)
    zoned = {n: F.col(n).cast("timestamp") for n, t in df.dtypes if t == "timestamp_ntz"}
    return df.withColumns(zoned) if zoned else df


def _blank_to_null(*names: str):
    return [F.nullif(F.col(n), F.lit("")).alias(n) for n in names]


def _usage(df: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    tags = {"Team": "tag_team", "ProductName": "tag_product_name", "Product": "tag_product", "Env": "tag_env"}
    return df.select(
        "record_id", "workspace_id", "sku_name", "cloud", "usage_start_time", "usage_end_time",
        "usage_date", "usage_quantity", "usage_type", "billing_origin_product",
        F.create_map(*[x for k, v in tags.items() for x in (F.lit(k), F.col(v))]).alias("custom_tags"),
        F.struct(F.col("run_as"), none.alias("created_by")).alias("identity_metadata"),
        F.struct(
            *_blank_to_null("cluster_id", "warehouse_id", "job_id", "job_run_id", "dlt_pipeline_id", "endpoint_name"),
            none.alias("notebook_id"), none.alias("endpoint_id"),
        ).alias("usage_metadata"),
    )


def _prices(df: DataFrame) -> DataFrame:
    return df.select(
        "sku_name", "cloud", "price_start_time", "price_end_time",
        F.struct(F.col("price_default").alias("default")).alias("pricing"),
    )


def _jobs(df: DataFrame) -> DataFrame:
    return df.select(
        "workspace_id", "job_id", "name", "creator_user_name", "run_as_user_name",
        F.create_map(F.lit("Env"), F.col("tag_env")).alias("tags"),
        F.struct(F.col("cron").alias("quartz_cron_expression"), F.col("pause_status")).alias("schedule"),
        "created_time", "change_time", "delete_time",
    )


def _audit(df: DataFrame) -> DataFrame:
    return df.select(
        "workspace_id", "event_time", "event_date", "service_name", "action_name", "user_agent", "event_id", "request_params",
        F.col("source_ip").alias("source_ip_address"),
        F.struct(F.col("user_email").alias("email")).alias("user_identity"),
        F.struct(F.col("status_code").alias("statusCode")).alias("response"),
    )


def _queries(df: DataFrame) -> DataFrame:
    return df.withColumn("compute", F.struct("warehouse_id")).drop("warehouse_id")


def _gcp(df: DataFrame) -> DataFrame:
    credits = F.array_compact(F.array(*[
        F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("amount"))) for c in ("credit_a", "credit_b")
    ]))
    return df.withColumn("credits", credits).drop("credit_a", "credit_b")


def _users(df: DataFrame) -> DataFrame:
    emails = F.array(
        F.struct(F.col("other_email").alias("value"), F.lit(False).alias("primary")),
        F.struct(F.col("email").alias("value"), F.col("email_is_primary").alias("primary")),
    )
    return df.withColumn("emails", emails).drop("other_email", "email_is_primary")


def _running(df: DataFrame) -> DataFrame:
    return df.withColumn("tags", F.create_map(F.lit("Environment"), F.col("tag_environment"))).drop("tag_environment")


def _landing_usage(df: DataFrame) -> DataFrame:
    return df.withColumn("custom_tags", F.create_map("tag_key", "tag_value")).drop("tag_key", "tag_value")


# logical table -> (flat view, wrapper)
VIEWS = {
    "access.workspaces_latest": ("workspaces", None),
    "billing.usage": ("usage_flat", _usage),
    "billing.list_prices": ("list_prices", _prices),
    "lakeflow.jobs": ("jobs", _jobs),
    "lakeflow.job_run_timeline": ("job_runs", None),
    "lakeflow.job_task_run_timeline": ("job_runs", None),
    "lakeflow.job_tasks": ("job_tasks", None),
    "lakeflow.pipelines": ("pipelines", None),
    "lakeflow.pipeline_update_timeline": ("pipeline_updates", None),
    "compute.clusters": ("clusters", None),
    "compute.warehouses": ("warehouses", None),
    "compute.node_types": ("node_types", None),
    "compute.node_timeline": ("node_timeline", None),
    "compute.cluster_events": ("cluster_events", None),
    "compute.warehouse_events": ("warehouse_events", None),
    "access.audit": ("audit", _audit),
    "platform.request_log": ("request_log", None),
    "query.history": ("query_history", _queries),
    "ai_gateway.usage": ("gateway_usage", None),
    "serving.endpoint_usage": ("endpoint_usage", None),
    "serving.served_entities": ("served_entities", None),
    "mlflow.experiments_latest": ("experiments", None),
    "mlflow.runs_latest": ("ml_runs", None),
    "mlflow.registered_models_latest": ("ml_models", None),
    "access.table_lineage": ("table_lineage", None),
    "access.column_lineage": ("column_lineage", None),
    "storage.optimization_operations": ("optimization_ops", None),
    "information_schema.tables": ("tables", None),
    "information_schema.catalogs": ("catalogs", None),
    "information_schema.catalog_privileges": ("catalog_privileges", None),
    "information_schema.schema_privileges": ("schema_privileges", None),
    "information_schema.row_filters": ("row_filters", None),
    "information_schema.column_masks": ("column_masks", None),
    "platform.cloud_costs": ("cloud_costs", None),
    "platform.azure_export": ("azure_export", None),
    "platform.aws_export": ("aws_export", None),
    "platform.gcp_export": ("gcp_export", _gcp),
    "platform.user_permissions": ("user_permissions", None),
    "directory.users": ("users", _users),
    "directory.groups": ("groups", None),
    "directory.group_members": ("group_members", None),
    "directory.group_entitlements": ("group_entitlements", None),
    "directory.workspace_assignments": ("workspace_assignments", None),
    "networking.private_endpoint_rules": ("private_endpoint_rules", None),
    "dashboards.dashboards": ("dashboards", None),
    "dashboards.dashboard_events": ("dashboard_events", None),
    "sql.alerts": ("sql_alerts", None),
    "marketplace.listing_events": ("listing_events", None),
    "marketplace.consumer_listings": ("consumer_listings", None),
    "marketplace.provider_listings": ("provider_listings", None),
    "live.running_resources": ("running_resources", _running),
    "landing.usage": ("landing_usage", _landing_usage),
    "landing.workspaces": ("landing_workspaces", None),
    "landing.tables": ("landing_tables", None),
    "landing.user_permissions": ("landing_permissions", None),
    "landing.alert_settings": ("landing_settings", None),
    "landing.list_prices": ("landing_prices", None),
}

_EVENT_BASED = (
    "access.audit", "platform.request_log", "query.history", "ai_gateway.usage", "serving.endpoint_usage",
    "compute.cluster_events", "compute.warehouse_events", "dashboards.dashboard_events",
    "marketplace.listing_events",
)


def _stream(sf_dir: str, flat: str, wrap, base: str):
    """The view with generated table ``base`` read as a file stream, the others as they are."""
    def build(spark: SparkSession) -> DataFrame:
        path = f"{sf_dir}/{base}.parquet"
        source = spark.readStream.schema(_read(spark, path).schema).option("pathGlobFilter", f"{base}.parquet").parquet(sf_dir)
        names = set(_TABLE_REF.findall(FLAT[flat]))
        tables = {t: source if t == base else _read(spark, f"{sf_dir}/{t}.parquet") for t in names}
        df = spark.sql(FLAT[flat], **tables)
        df = df.withColumns({n: F.col(n).cast("timestamp") for n, t in df.dtypes if t == "timestamp_ntz"})
        return wrap(df) if wrap else df

    return build


def _view(sf_dir: str, flat: str, wrap):
    def build(spark: SparkSession) -> DataFrame:
        df = _flat(spark, sf_dir, flat)
        return wrap(df) if wrap else df

    return build


def testdata_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    locations = {name: _view(sf_dir, flat, wrap) for name, (flat, wrap) in VIEWS.items()}
    bases = {"billing.usage": "lineitem", "platform.cloud_costs": "lineitem", "platform.request_log": "events"}
    streams = {name: _stream(sf_dir, *VIEWS[name], base) for name, base in bases.items()}
    return Catalog(spark, locations, streams=streams)


def testdata_ctx(spark: SparkSession, sf_dir: str) -> Ctx:
    return Ctx(
        spark, testdata_catalog(spark, sf_dir), as_of=USAGE_DAY,
        table_days={name: EVENTS_DAY for name in _EVENT_BASED},
    )
