from oracle.sql import COST, DERIVED, MINUTES, UNITS, day, eday, ets_within, oracle, pct, r, ts_within, within

# ---- compute ----
DERIVED["clusters_all"] = """
SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY change_time DESC, cluster_name DESC, workspace_id DESC, owned_by DESC, cluster_source DESC NULLS LAST, runtime_version DESC, driver_node_type DESC, worker_node_type DESC,
  min_autoscale_workers DESC, max_autoscale_workers DESC, auto_termination_minutes DESC, delete_time DESC NULLS LAST) AS rn FROM v_clusters"""
DERIVED["clusters_gone"] = "SELECT cluster_id FROM v_clusters_all WHERE rn = 1 AND delete_time IS NOT NULL"
DERIVED["clusters_now"] = """
SELECT cluster_id, cluster_name, workspace_id, owned_by AS owner, cluster_source, runtime_version, driver_node_type, worker_node_type, min_autoscale_workers, max_autoscale_workers, auto_termination_minutes, change_time AS last_modified, delete_time
FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY change_time DESC, cluster_name DESC, workspace_id DESC, owned_by DESC, cluster_source DESC NULLS LAST, runtime_version DESC, driver_node_type DESC, worker_node_type DESC,
  min_autoscale_workers DESC, max_autoscale_workers DESC, auto_termination_minutes DESC, delete_time DESC NULLS LAST) AS k FROM v_clusters WHERE cluster_source IS NULL OR cluster_source <> 'JOB')
WHERE k = 1 AND cluster_id NOT IN (SELECT cluster_id FROM v_clusters_gone)"""
DERIVED["warehouses_all"] = """
SELECT *, row_number() OVER (PARTITION BY warehouse_id ORDER BY change_time DESC, warehouse_name DESC, workspace_id DESC, warehouse_type DESC, warehouse_size DESC, min_clusters DESC, max_clusters DESC, auto_stop_minutes DESC, delete_time DESC NULLS LAST) AS rn FROM v_warehouses"""
DERIVED["warehouses_now"] = "SELECT warehouse_id, warehouse_name, workspace_id, warehouse_type, warehouse_size, min_clusters, max_clusters, auto_stop_minutes, change_time AS last_modified FROM v_warehouses_all WHERE rn = 1 AND delete_time IS NULL"
DERIVED["warehouse_ws"] = "SELECT warehouse_id, workspace_id FROM v_warehouses_all WHERE rn = 1"


def spend() -> str:
    out = []
    for d in (30, 60, 90):
        for c, n in (("usage_quantity", "units"), ("cost", "cost")):
            out.append(f"{r(f'COALESCE(SUM(CASE WHEN usage_date >= {day(d)} THEN {c} END), 0)', 2)} AS {n}_{d}d")
    return ", ".join(out)


DERIVED["pipeline_spend"] = f"SELECT dlt_pipeline_id AS pipeline_id, workspace_id, {spend()}, COUNT(DISTINCT usage_date) AS active_days FROM v_priced WHERE {within(90)} AND dlt_pipeline_id IS NOT NULL GROUP BY 1, 2"
DERIVED["resource_spend"] = f"""SELECT COALESCE(cluster_id, warehouse_id) AS resource_id, {spend()}, COUNT(*) FILTER (usage_date >= {day(30)}) AS rows_30d, COUNT(*) FILTER (usage_date >= {day(60)}) AS rows_60d, COUNT(*) AS rows_90d,
  COUNT(DISTINCT usage_date) AS active_days FROM v_priced WHERE {within(90)} AND COALESCE(cluster_id, warehouse_id) IS NOT NULL GROUP BY 1"""
BUSY = "CASE WHEN num_task_slots > 0 THEN CAST(avg_num_running_tasks AS DOUBLE) / num_task_slots * 100 ELSE 0 END"
DERIVED["node_util"] = f"""SELECT cluster_id, workspace_id, COUNT(DISTINCT node_id) AS node_count, {r('SUM(uptime_seconds) / 3600', 1)} AS total_node_hours, {r(f'AVG({BUSY})', 1)} AS avg_task_util_pct, {r(f'MAX({BUSY})', 1)} AS peak_task_util_pct,
  {r('AVG(CAST(avg_num_queued_tasks AS DOUBLE))', 2)} AS avg_queued_tasks, COUNT(*) FILTER (is_driver) AS driver_samples, COUNT(*) FILTER (NOT is_driver) AS worker_samples
FROM v_node_timeline WHERE {ts_within(7, 'start_time')} GROUP BY 1, 2"""
DERIVED["hardware"] = f"SELECT node_type_id, num_cpus, memory_mb, {r('memory_mb / 1024', 1)} AS memory_gb, COALESCE(num_gpus, 0) AS num_gpus, COALESCE(gpu_name, '') AS gpu_name, is_deprecated, category FROM v_node_types"
oracle("clusters_latest", "SELECT * FROM v_clusters_now")
oracle("anti_deleted", "SELECT DISTINCT cluster_id FROM v_clusters WHERE cluster_id NOT IN (SELECT cluster_id FROM v_clusters_gone)")
oracle("warehouses_latest", "SELECT * FROM v_warehouses_now")
oracle("warehouse_workspace", "SELECT * FROM v_warehouse_ws")
oracle("pipeline_spend_306090", "SELECT * FROM v_pipeline_spend")
oracle("recent_active_ids", f"SELECT DISTINCT COALESCE(cluster_id, warehouse_id) AS resource_id FROM v_usage_flat WHERE {within(30)} AND COALESCE(cluster_id, warehouse_id) IS NOT NULL")
oracle("resource_spend_306090", "SELECT * FROM v_resource_spend")
oracle("node_task_utilisation", "SELECT * FROM v_node_util")
oracle("node_types", "SELECT * FROM v_hardware")
SP = "COALESCE(s.units_30d, 0.0) AS units_30d, COALESCE(s.cost_30d, 0.0) AS cost_30d, COALESCE(s.units_60d, 0.0) AS units_60d, COALESCE(s.cost_60d, 0.0) AS cost_60d, COALESCE(s.units_90d, 0.0) AS units_90d, COALESCE(s.cost_90d, 0.0) AS cost_90d, COALESCE(s.active_days, 0) AS active_days"
HW = "d.num_cpus AS driver_cpus, d.memory_gb AS driver_mem_gb, k.num_cpus AS worker_cpus, k.memory_gb AS worker_mem_gb, NULLIF(k.num_gpus, 0) AS worker_gpus"
HWJ = "LEFT JOIN v_hardware d ON c.driver_node_type = d.node_type_id LEFT JOIN v_hardware k ON c.worker_node_type = k.node_type_id"
oracle("join_enrich_compute", f"""
SELECT c.cluster_id, w.workspace_name, w.resource_group, {HW}, COALESCE(s.cost_30d, 0.0) AS cost_30d, COALESCE(s.cost_90d, 0.0) AS cost_90d, COALESCE(s.active_days, 0) AS active_days
FROM v_clusters_now c LEFT JOIN v_workspaces w USING (workspace_id) {HWJ} LEFT JOIN v_resource_spend s ON c.cluster_id = s.resource_id""")
DERIVED["cluster_sizing"] = f"""
SELECT c.cluster_id, c.cluster_name, c.workspace_id, c.owner, c.cluster_source, c.runtime_version, c.driver_node_type, c.worker_node_type, c.last_modified, c.delete_time, c.min_autoscale_workers AS min_workers, c.max_autoscale_workers AS max_workers, c.auto_termination_minutes AS auto_terminate_minutes,
  concat_ws(',', CASE WHEN c.delete_time IS NOT NULL THEN 'terminated' END, CASE WHEN c.delete_time IS NULL AND c.auto_termination_minutes = 0 THEN 'no_auto_terminate' END,
    CASE WHEN c.delete_time IS NULL AND c.min_autoscale_workers = c.max_autoscale_workers AND c.max_autoscale_workers > 0 THEN 'fixed_size' END, CASE WHEN c.delete_time IS NULL AND c.min_autoscale_workers >= 8 THEN 'large_min_workers' END) AS flags,
  w.workspace_name, w.subscription_id, w.resource_group, {SP}, u.node_count, u.total_node_hours, u.avg_task_util_pct, u.peak_task_util_pct, u.avg_queued_tasks, {HW}
FROM v_clusters_now c LEFT JOIN v_workspaces w USING (workspace_id) LEFT JOIN v_resource_spend s ON c.cluster_id = s.resource_id
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY total_node_hours DESC, workspace_id DESC) AS n FROM v_node_util) u ON c.cluster_id = u.cluster_id AND u.n = 1 {HWJ}"""
oracle("cluster_sizing", "SELECT * FROM v_cluster_sizing")
DERIVED["warehouse_sizing"] = f"""
SELECT c.*, concat_ws(',', CASE WHEN c.auto_stop_minutes = 0 THEN 'no_auto_stop' END, CASE WHEN c.min_clusters > 1 THEN 'min_clusters_gt_1' END) AS flags, w.workspace_name, w.subscription_id, w.resource_group, {SP}
FROM v_warehouses_now c LEFT JOIN v_workspaces w USING (workspace_id) LEFT JOIN v_resource_spend s ON c.warehouse_id = s.resource_id"""
oracle("warehouse_sizing", "SELECT * FROM v_warehouse_sizing")
oracle("runtime_versions", "SELECT runtime_version AS version, COUNT(*) AS cluster_count FROM v_clusters_now GROUP BY 1")
oracle("warehouse_sizes", "SELECT warehouse_size AS size, COUNT(*) AS warehouse_count FROM v_warehouses_now GROUP BY 1")
DERIVED["pipeline_sizing"] = """
SELECT s.*, COALESCE(i.name, concat(substr(s.pipeline_id, 1, 20), '…')) AS name, COALESCE(i.trigger_type, 'Unknown') AS trigger_type, i.has_trigger, w.workspace_name, w.subscription_id, w.resource_group
FROM v_pipeline_spend s LEFT JOIN (SELECT pipeline_id, name, CASE trigger_kind WHEN 'CONTINUOUS' THEN 'Continuous' WHEN 'CRON' THEN 'Cron' WHEN 'FILE_ARRIVAL' THEN 'File Arrival' WHEN 'MANUAL' THEN 'Manual' ELSE 'None' END AS trigger_type,
  COALESCE(trigger_kind IN ('CONTINUOUS', 'CRON', 'FILE_ARRIVAL'), FALSE) AS has_trigger FROM v_pipelines_latest QUALIFY row_number() OVER (PARTITION BY pipeline_id ORDER BY change_time DESC, workspace_id DESC) = 1) i USING (pipeline_id) LEFT JOIN v_workspaces w USING (workspace_id)"""
oracle("pipeline_sizing", "SELECT * FROM v_pipeline_sizing")
oracle("join_pipeline_info", f"SELECT trigger_type, has_trigger, COUNT(*) AS pipelines, {r('SUM(cost_90d)', 2)} AS cost_90d FROM v_pipeline_sizing GROUP BY 1, 2")
oracle("compute_summary", """
SELECT COUNT(*) AS total_clusters, COUNT(*) FILTER (contains(flags, 'no_auto_terminate')) AS no_auto_terminate, COUNT(*) FILTER (contains(flags, 'fixed_size')) AS no_autoscale, COUNT(*) FILTER (contains(flags, 'large_min_workers')) AS oversized_clusters,
  COUNT(DISTINCT runtime_version) AS runtime_versions_in_use, COUNT(*) FILTER (avg_task_util_pct < 20 AND cost_30d > 10) AS underutilised, (SELECT COUNT(*) FROM v_warehouse_sizing) AS total_warehouses,
  (SELECT COUNT(*) FILTER (contains(flags, 'no_auto_stop')) FROM v_warehouse_sizing) AS no_auto_stop, (SELECT COUNT(*) FROM v_pipeline_spend) AS total_pipelines, (SELECT COUNT(*) FILTER (NOT has_trigger) FROM v_pipeline_sizing) AS pipelines_no_trigger
FROM v_cluster_sizing""")

# ---- query attribution ----
QW = f"{ets_within(90, 'start_time')} AND statement_type <> 'OTHER'"
INTERACTIVE = "executed_by IS NOT NULL AND trim(executed_by) <> '' AND executed_by = executed_as"


def gib(x: str, n: int = 2) -> str:
    return r(f"CAST({x} AS DOUBLE) / 1073741824", n)


def sec(x: str, n: int) -> str:
    return r(f"CAST({x} AS DOUBLE) / 1000", n)


VOLUME = f"""COUNT(*) AS queries_90d, COUNT(*) FILTER (CAST(start_time AS DATE) >= {eday(60)}) AS queries_60d, COUNT(*) FILTER (CAST(start_time AS DATE) >= {eday(30)}) AS queries_30d, {sec('SUM(total_duration_ms)', 1)} AS total_duration_sec, {sec('AVG(total_duration_ms)', 2)} AS avg_duration_sec,
  {gib('SUM(read_bytes)')} AS gb_90d, {gib(f'SUM(CASE WHEN CAST(start_time AS DATE) >= {eday(60)} THEN read_bytes ELSE 0 END)')} AS gb_60d, {gib(f'SUM(CASE WHEN CAST(start_time AS DATE) >= {eday(30)} THEN read_bytes ELSE 0 END)')} AS gb_30d, COUNT(*) FILTER (error_message IS NOT NULL) AS failed_count"""
DERIVED["user_stats"] = f"""SELECT executed_by AS user_email, {VOLUME}, COUNT(DISTINCT warehouse_id) AS warehouses_used, COUNT(*) FILTER (error_message IS NULL) AS success_count FROM v_query_history WHERE {QW} AND {INTERACTIVE} GROUP BY 1"""
oracle("query_user_stats", "SELECT * FROM v_user_stats")
oracle("query_daily_trend", f"SELECT CAST(start_time AS DATE) AS day, COUNT(*) AS query_count, COUNT(DISTINCT executed_by) AS unique_users, {gib('SUM(read_bytes)')} AS gb_scanned, {sec('AVG(total_duration_ms)', 2)} AS avg_duration_sec FROM v_query_history WHERE {QW} GROUP BY 1")
DERIVED["wh_spend"] = f"SELECT warehouse_id, {spend()} FROM v_priced WHERE {within(90)} AND warehouse_id IS NOT NULL GROUP BY 1"


def durations(prefix: str) -> str:
    return ", ".join(f"CAST(COALESCE(SUM(CASE WHEN CAST(start_time AS DATE) >= {eday(d)} THEN total_duration_ms END), 0) AS BIGINT) AS {prefix}_{d}d" for d in (30, 60, 90))


DERIVED["user_wh_ms"] = f"SELECT executed_by AS user_email, warehouse_id, {durations('user_ms')} FROM v_query_history WHERE {QW} AND {INTERACTIVE} AND warehouse_id IS NOT NULL GROUP BY 1, 2"
DERIVED["wh_ms"] = f"SELECT warehouse_id, {durations('total_ms')} FROM v_query_history WHERE {QW} AND warehouse_id IS NOT NULL GROUP BY 1"
STMT = f"""statement_id, executed_by AS user_email, warehouse_id, statement_type, substr(statement_text, 1, 200) AS query_preview, CASE WHEN error_message IS NULL THEN 'FINISHED' ELSE 'FAILED' END AS status, {sec('total_duration_ms', 2)} AS duration_sec, {gib('read_bytes', 3)} AS gb_scanned, start_time AS started_at"""
EST = f"{r('COALESCE(b.duration_sec * 1000 / NULLIF(m.total_ms_90d, 0) * s.cost_90d, 0)', 2)} AS estimated_cost"
PRICED_STMT = "FROM b LEFT JOIN v_wh_ms m USING (warehouse_id) LEFT JOIN v_wh_spend s USING (warehouse_id) LEFT JOIN v_warehouse_ws x USING (warehouse_id) LEFT JOIN v_workspaces w USING (workspace_id)"
oracle("top_expensive_queries", f"WITH b AS (SELECT {STMT}, {r('CAST(read_rows AS DOUBLE) / 1000000', 2)} AS m_rows_read FROM v_query_history WHERE {QW} AND read_bytes > 0 ORDER BY read_bytes DESC, statement_id LIMIT 50) SELECT b.*, {EST}, x.workspace_id, w.workspace_name {PRICED_STMT}")
SLOW = f"b AS (SELECT {STMT} FROM v_query_history WHERE {QW} AND total_duration_ms > 60000 ORDER BY total_duration_ms DESC, statement_id LIMIT 50)"
oracle("slow_queries", f"WITH {SLOW} SELECT b.*, {EST}, x.workspace_id, w.workspace_name {PRICED_STMT}")
oracle("query_cost_estimate", f"SELECT q.statement_id, q.warehouse_id, {r('COALESCE(CAST(q.total_duration_ms AS DOUBLE) / NULLIF(m.total_ms_90d, 0) * s.cost_90d, 0)', 4)} AS estimated_cost FROM v_query_history q JOIN v_wh_ms m USING (warehouse_id) LEFT JOIN v_wh_spend s USING (warehouse_id) WHERE {QW}")
oracle("query_warehouse_stats", f"""
SELECT q.*, COALESCE(s.units_30d, 0.0) AS units_30d, COALESCE(s.cost_30d, 0.0) AS cost_30d, COALESCE(s.units_60d, 0.0) AS units_60d, COALESCE(s.cost_60d, 0.0) AS cost_60d, COALESCE(s.units_90d, 0.0) AS units_90d, COALESCE(s.cost_90d, 0.0) AS cost_90d
FROM (SELECT warehouse_id, {VOLUME}, COUNT(DISTINCT executed_by) AS unique_users FROM v_query_history WHERE {QW} AND warehouse_id IS NOT NULL GROUP BY 1) q LEFT JOIN v_wh_spend s USING (warehouse_id)""")
oracle("warehouse_spend_306090", "SELECT * FROM v_wh_spend")
oracle("user_warehouse_duration", "SELECT * FROM v_user_wh_ms")
oracle("warehouse_total_duration", "SELECT * FROM v_wh_ms")
ATT = ", ".join(f"COALESCE(CAST(u.user_ms_{d}d AS DOUBLE) / NULLIF(m.total_ms_{d}d, 0) * s.cost_{d}d, 0) AS share_{d}d" for d in (30, 60, 90))
DERIVED["attributed"] = f"SELECT u.user_email, u.warehouse_id, {ATT} FROM v_user_wh_ms u JOIN v_wh_ms m USING (warehouse_id) LEFT JOIN v_wh_spend s USING (warehouse_id)"
oracle("join_attribution", f"SELECT user_email, warehouse_id, {r('share_90d', 4)} AS cost_90d FROM v_attributed")
oracle("user_cost_attribution", f"SELECT user_email, {r('SUM(share_30d)', 2)} AS cost_30d, {r('SUM(share_60d)', 2)} AS cost_60d, {r('SUM(share_90d)', 2)} AS cost_90d FROM v_attributed GROUP BY 1")
oracle("warehouse_events", f"""
WITH b AS (SELECT warehouse_id, event_time, event_type, cluster_count FROM v_warehouse_events WHERE {ets_within(7, 'event_time')})
SELECT b.*, x.workspace_id, w.workspace_name FROM b LEFT JOIN v_warehouse_ws x USING (warehouse_id) LEFT JOIN v_workspaces w USING (workspace_id)""")
oracle("query_summary", f"SELECT CAST(SUM(queries_90d) AS BIGINT) AS total_queries, {r('SUM(gb_90d)', 2)} AS total_gb_scanned, COUNT(*) AS unique_users, CAST(SUM(failed_count) AS BIGINT) AS total_failed, (SELECT COUNT(*) FROM v_query_history WHERE {QW} AND total_duration_ms > 60000) AS slow_queries FROM v_user_stats")

# ---- jobs ----
R30 = ts_within(30, "period_start_time")
PROD = "JOIN (SELECT workspace_id, workspace_name FROM v_workspaces WHERE lower(workspace_name) LIKE '%prod%') w USING (workspace_id)"
BAD = "result_state IN ('FAILED', 'CANCELLED', 'TIMED_OUT', 'ERROR')"
DERIVED["prod_runs"] = f"SELECT * FROM v_job_runs {PROD} WHERE {R30}"
DERIVED["prod_updates"] = f"SELECT * FROM v_pipeline_updates {PROD} WHERE {R30} AND period_end_time IS NOT NULL AND result_state IS NOT NULL"
OUT = f"COUNT(*) FILTER (result_state = 'SUCCEEDED') AS success_count, COUNT(*) FILTER ({BAD}) AS failed_count"
DERIVED["job_stats"] = f"""SELECT job_id, workspace_id, workspace_name, run_type, COUNT(*) AS total_runs, {OUT}, {r(f"AVG(CASE WHEN result_state = 'SUCCEEDED' THEN {MINUTES} END)", 1)} AS avg_duration_min, {r(f"MAX(CASE WHEN result_state = 'SUCCEEDED' THEN {MINUTES} END)", 1)} AS max_duration_min,
  MAX(period_end_time) AS last_run_at, arg_max(result_state, row(period_end_time, run_id)) AS last_result FROM v_prod_runs WHERE result_state IS NOT NULL GROUP BY 1, 2, 3, 4"""
DERIVED["job_inv"] = f"SELECT workspace_id, job_id, name AS job_name, creator_user_name AS creator, run_as_user_name AS run_as, created_time AS created_at, cron AS cron_schedule, pause_status AS schedule_status FROM v_jobs_latest {PROD}"
DERIVED["pipe_inv"] = f"SELECT workspace_id, pipeline_id, name AS pipeline_name, workspace_name, creator_user_name AS creator, run_as_user_name AS run_as, channel, edition, created_time AS created_at FROM v_pipelines_latest {PROD}"
DERIVED["failures"] = f"SELECT run_id, job_id, workspace_id, workspace_name, result_state, period_start_time AS started_at, {r(MINUTES, 1)} AS duration_min FROM v_prod_runs WHERE {BAD} ORDER BY started_at DESC, run_id LIMIT 50"
DERIVED["pipe_stats"] = f"""SELECT s.*, i.pipeline_name, {pct('success_count', 'total_runs')} AS success_rate FROM (SELECT pipeline_id, workspace_id, workspace_name, COUNT(DISTINCT update_id) AS total_runs, COUNT(*) FILTER (result_state = 'COMPLETED') AS success_count, COUNT(*) FILTER (result_state IN ('FAILED', 'CANCELED')) AS failed_count,
  {r(f"AVG(CASE WHEN result_state = 'COMPLETED' THEN {MINUTES} END)", 1)} AS avg_duration_min, MAX(period_end_time) AS last_run_at FROM v_prod_updates GROUP BY 1, 2, 3) s LEFT JOIN v_pipe_inv i USING (workspace_id, pipeline_id)"""
DERIVED["tasks_latest"] = """SELECT workspace_id, job_id, task_key FROM (
  SELECT *, row_number() OVER (PARTITION BY workspace_id, job_id, task_key ORDER BY change_time DESC, delete_time DESC NULLS LAST) AS rn FROM v_job_tasks) WHERE rn = 1 AND delete_time IS NULL"""
DERIVED["tasks_n"] = f"SELECT workspace_id, job_id, COUNT(*) AS task_count FROM v_tasks_latest {PROD} GROUP BY 1, 2"
DERIVED["bottlenecks"] = f"""SELECT s.*, i.job_name FROM (SELECT job_id, task_key, workspace_id, workspace_name, COUNT(*) AS run_count, {OUT}, {r(f'AVG({MINUTES})', 1)} AS avg_duration_min, {r(f'MAX({MINUTES})', 1)} AS max_duration_min
  FROM v_prod_runs WHERE period_end_time IS NOT NULL GROUP BY 1, 2, 3, 4) s LEFT JOIN v_job_inv i USING (workspace_id, job_id)"""
oracle("job_runs", f"SELECT * FROM v_job_stats")
oracle("join_prod_inner", "SELECT workspace_id, workspace_name, COUNT(*) AS runs FROM v_prod_runs WHERE result_state IS NOT NULL GROUP BY 1, 2")
oracle("job_daily", f"SELECT CAST(period_start_time AS DATE) AS day, COUNT(*) AS total_runs, {OUT} FROM v_prod_runs WHERE result_state IS NOT NULL GROUP BY 1")
oracle("jobs_inventory", "SELECT * FROM v_job_inv")
oracle("top_failures", "SELECT * FROM v_failures")
oracle("join_job_inventory", "SELECT f.*, COALESCE(i.job_name, '') AS job_name FROM v_failures f LEFT JOIN v_job_inv i USING (workspace_id, job_id)")
oracle("pipeline_runs", "SELECT * FROM v_pipe_stats")
SLA = f"""
WITH j AS (SELECT 'job' AS kind, run_id, CAST(period_start_time AS DATE) AS d, result_state = 'SUCCEEDED' AS ok, {BAD} AS bad FROM v_prod_runs JOIN v_jobs_latest USING (workspace_id, job_id) WHERE result_state IS NOT NULL
  UNION ALL SELECT 'pipeline', update_id, CAST(period_start_time AS DATE), result_state = 'COMPLETED', result_state IN ('FAILED', 'CANCELED') FROM (SELECT * FROM v_pipeline_updates {PROD} WHERE {R30} AND result_state IS NOT NULL) JOIN v_pipelines_latest USING (workspace_id, pipeline_id)),
k AS (SELECT kind, COUNT(DISTINCT run_id) AS n30, COUNT(DISTINCT CASE WHEN d >= {day(7)} THEN run_id END) AS n7, COUNT(*) FILTER (ok) AS o30, COUNT(*) FILTER (ok AND d >= {day(7)}) AS o7, COUNT(*) FILTER (bad) AS b30, COUNT(*) FILTER (bad AND d >= {day(7)}) AS b7 FROM j GROUP BY 1),
s AS (SELECT """ + ", ".join(
    f"CAST(COALESCE(SUM(n{d}), 0) AS BIGINT) AS total_runs_{d}d, CAST(COALESCE(SUM(o{d}), 0) AS BIGINT) AS succeeded_{d}d, CAST(COALESCE(SUM(b{d}), 0) AS BIGINT) AS failed_{d}d, "
    f"CAST(COALESCE(SUM(n{d}) FILTER (kind = 'job'), 0) AS BIGINT) AS job_runs_{d}d, CAST(COALESCE(SUM(n{d}) FILTER (kind = 'pipeline'), 0) AS BIGINT) AS pipeline_runs_{d}d" for d in (7, 30)
) + f" FROM k) SELECT *, {pct('succeeded_7d', 'total_runs_7d')} AS sla_pct_7d, {pct('succeeded_30d', 'total_runs_30d')} AS sla_pct_30d FROM s"
oracle("combined_sla", SLA)
oracle("job_task_counts", "SELECT * FROM v_tasks_n")
oracle("task_bottlenecks", "SELECT * FROM v_bottlenecks")
oracle("pipelines_inventory", "SELECT * FROM v_pipe_inv")
oracle("pipeline_updates", f"""SELECT s.*, i.pipeline_name FROM (SELECT update_id, pipeline_id, workspace_id, workspace_name, result_state AS state, {r(MINUTES, 1)} AS duration_min, period_start_time AS started_at, period_end_time AS ended_at FROM v_prod_updates) s LEFT JOIN v_pipe_inv i USING (workspace_id, pipeline_id)""")
oracle("job_report", f"""SELECT s.*, i.job_name, i.creator, i.run_as, i.created_at, i.cron_schedule, i.schedule_status, COALESCE(t.task_count, 0) AS task_count, {pct('success_count', 'total_runs')} AS success_rate
FROM (SELECT * FROM v_job_stats) s LEFT JOIN v_job_inv i USING (workspace_id, job_id) LEFT JOIN v_tasks_n t USING (workspace_id, job_id)""")
oracle("job_report_summary", f"""SELECT COUNT(*) AS total_jobs, CAST(SUM(total_runs) AS BIGINT) AS total_runs, CAST(SUM(success_count) AS BIGINT) AS total_success, CAST(SUM(failed_count) AS BIGINT) AS total_failed, {pct('SUM(success_count)', 'SUM(total_runs)')} AS sla_pct,
  (SELECT COUNT(*) FROM (SELECT DISTINCT pipeline_id, workspace_id FROM v_prod_updates)) AS pipelines, (SELECT COUNT(*) FROM (SELECT DISTINCT job_id, task_key, workspace_id FROM v_prod_runs WHERE period_end_time IS NOT NULL)) AS task_bottlenecks, (SELECT COUNT(*) FROM v_pipe_inv) AS pipeline_inventory FROM v_job_stats""")

# ---- lineage, serving, ML registry ----
DERIVED["edges"] = f"SELECT DISTINCT concat_ws('.', source_catalog, source_schema, source_table) AS source, concat_ws('.', target_catalog, target_schema, target_table) AS target FROM v_table_lineage WHERE {ts_within(30, 'event_time')}"
oracle("table_lineage_edges", "SELECT * FROM v_edges")
oracle("column_lineage", f"SELECT * FROM v_column_lineage WHERE {ts_within(30, 'event_time')}")
oracle("lineage_tables", "SELECT table_name, CAST(SUM(o) AS BIGINT) AS edges_out, CAST(SUM(i) AS BIGINT) AS edges_in FROM (SELECT source AS table_name, 1 AS o, 0 AS i FROM v_edges UNION ALL SELECT target, 0, 1 FROM v_edges) GROUP BY 1")
DERIVED["serve_days"] = f"SELECT served_entity_name AS entity_name, CAST(request_time AS DATE) AS day, COUNT(*) AS request_count, {r('AVG(total_token_count)', 1)} AS avg_tokens, COUNT(*) FILTER (status_code >= 400) AS error_count FROM v_endpoint_usage WHERE {ets_within(30, 'request_time')} GROUP BY 1, 2"
oracle("serving_daily", "SELECT * FROM v_serve_days")
oracle("join_endpoint_outer", "SELECT COALESCE(e.served_entity_name, u.entity_name) AS entity_name, e.endpoint_name, u.requests FROM v_served_entities e FULL OUTER JOIN (SELECT entity_name, CAST(SUM(request_count) AS BIGINT) AS requests FROM v_serve_days GROUP BY 1) u ON e.served_entity_name = u.entity_name")
oracle("serving_summary", f"""
SELECT COALESCE(e.endpoint_name, u.entity_name) AS endpoint_name, CAST(COALESCE(SUM(request_count), 0) AS BIGINT) AS total_requests, CAST(COALESCE(SUM(error_count), 0) AS BIGINT) AS total_errors, COUNT(day) AS active_days,
  COALESCE({r('SUM(avg_tokens * request_count) FILTER (avg_tokens > 0) / SUM(request_count) FILTER (avg_tokens > 0)', 1)}, 0.0) AS avg_tokens, {pct('COALESCE(SUM(error_count), 0)', 'SUM(request_count)')} AS error_rate
FROM v_served_entities e FULL OUTER JOIN v_serve_days u ON e.served_entity_name = u.entity_name GROUP BY 1""")
oracle("ml_experiments", "SELECT experiment_id, name AS experiment_name, lifecycle_stage, make_timestamp(creation_time * 1000) AS created_at, make_timestamp(last_update_time * 1000) AS updated_at FROM v_experiments")
oracle("ml_models", "SELECT name AS model_name, make_timestamp(creation_timestamp * 1000) AS created_at, make_timestamp(last_updated_timestamp * 1000) AS updated_at, user_id AS owner FROM v_ml_models")
DERIVED["runs_ml"] = f"SELECT run_id, experiment_id, status, start_time AS started_at, end_time AS ended_at, user_id AS user_email FROM v_ml_runs WHERE {ts_within(30, 'start_time')}"
oracle("ml_runs", "SELECT * FROM v_runs_ml")
oracle("ml_runs_summary", f"SELECT COUNT(*) AS total_runs, COUNT(*) FILTER (status = 'FINISHED') AS finished, COUNT(*) FILTER (status = 'FAILED') AS failed, {pct(chr(67) + 'OUNT(*) FILTER (status = ' + chr(39) + 'FINISHED' + chr(39) + ')', 'COUNT(*)')} AS success_rate FROM v_runs_ml")

# ---- storage ----
DERIVED["ops"] = f"SELECT catalog_name, schema_name, table_name, operation_type, operation_status, start_time AS started_at, {r('(epoch(end_time) - epoch(start_time)) / 60.0', 1)} AS duration_min, operation_id FROM v_optimization_ops WHERE {ts_within(30, 'start_time')}"
DERIVED["user_tables"] = "SELECT table_catalog AS catalog_name, table_schema AS schema_name, table_name, table_type, created AS created_at FROM v_tables WHERE table_schema <> 'information_schema' AND table_catalog NOT IN ('system', 'samples') AND table_type IN ('MANAGED', 'EXTERNAL')"
DERIVED["inv"] = "SELECT * FROM v_user_tables"
DERIVED["schemas"] = "SELECT catalog_name, schema_name, COUNT(*) AS table_count FROM v_user_tables GROUP BY 1, 2"
oracle("optimization_ops", "SELECT * FROM v_ops")
oracle("optimization_summary", "SELECT operation_type, COUNT(*) AS total, COUNT(*) FILTER (operation_status = 'SUCCEEDED') AS success, COUNT(*) FILTER (operation_status = 'FAILED') AS failed FROM v_ops GROUP BY 1")
oracle("table_inventory", "SELECT * FROM v_inv")
oracle("schema_summary", "SELECT * FROM v_schemas")
oracle("catalog_summary", "SELECT s.*, COUNT(*) OVER (PARTITION BY catalog_name) AS catalog_schemas, CAST(SUM(table_count) OVER (PARTITION BY catalog_name) AS BIGINT) AS catalog_tables FROM v_schemas s")
oracle("table_types", "SELECT table_type, COUNT(*) AS table_count FROM v_inv GROUP BY 1")
oracle("workspace_inventory", "SELECT workspace_id, workspace_name, workspace_url, workspace_status, CASE WHEN cloud <> '' THEN cloud WHEN contains(workspace_url, 'azure') THEN 'Azure' WHEN contains(workspace_url, 'aws') THEN 'AWS' ELSE 'GCP' END AS cloud, region FROM v_workspaces")
oracle("storage_summary", """SELECT COUNT(DISTINCT catalog_name) AS total_catalogs, COUNT(*) AS total_schemas, CAST(SUM(table_count) AS BIGINT) AS total_tables, (SELECT COUNT(*) FILTER (table_type = 'MANAGED') FROM v_inv) AS managed_tables,
  (SELECT COUNT(*) FILTER (table_type = 'EXTERNAL') FROM v_inv) AS external_tables, (SELECT COUNT(*) FROM v_ops) AS optimization_ops, (SELECT COUNT(DISTINCT operation_type) FROM v_ops) AS op_types, (SELECT COUNT(*) FROM v_workspaces) AS total_workspaces FROM v_schemas""")

# ---- cluster health ----
DERIVED["cl_events"] = f"SELECT event_time, cluster_id, event_type, workspace_id, event_ref FROM v_cluster_events WHERE {ets_within(30, 'event_time')} "
FAILT = "event_type IN ('FAILED', 'ERROR', 'DRIVER_NOT_FOUND', 'DRIVER_UNAVAILABLE', 'SPARK_ERROR')"
SCALET = "event_type IN ('RESIZING', 'UPSIZE_COMPLETED', 'NODES_LOST', 'AUTOSCALING_STATS_REPORT')"
CPU, MEM = "(CAST(cpu_user_percent AS DOUBLE) + CAST(cpu_system_percent AS DOUBLE))", "CAST(mem_used_percent AS DOUBLE)"
UTIL = f"{r(f'AVG({CPU})', 1)} AS avg_cpu_pct, {r(f'MAX({CPU})', 1)} AS peak_cpu_pct, {r(f'AVG({MEM})', 1)} AS avg_mem_pct, {r(f'MAX({MEM})', 1)} AS peak_mem_pct, COUNT(DISTINCT node_id) AS node_count"
DERIVED["cl_util"] = f"SELECT cluster_id, {UTIL}, COUNT(DISTINCT CAST(start_time AS DATE)) AS active_days FROM v_node_timeline WHERE {ts_within(7, 'start_time')} GROUP BY 1"
oracle("cluster_events", "SELECT * FROM v_cl_events")
oracle("cluster_event_summary", f"SELECT cluster_id, event_type, COUNT(*) AS event_count, MIN(event_time) AS first_seen, MAX(event_time) AS last_seen FROM v_cluster_events WHERE {ets_within(30, 'event_time')} GROUP BY 1, 2")
oracle("node_utilisation_daily", f"SELECT cluster_id, is_driver AS driver, CAST(start_time AS DATE) AS day, {UTIL} FROM v_node_timeline WHERE {ts_within(7, 'start_time')} GROUP BY 1, 2, 3")
oracle("cluster_utilisation", "SELECT * FROM v_cl_util")
oracle("failure_events", f"SELECT * FROM v_cl_events WHERE {FAILT}")
oracle("scale_events", f"SELECT * FROM v_cl_events WHERE {SCALET}")
oracle("cluster_event_types", "SELECT event_type, COUNT(*) AS event_count FROM v_cl_events GROUP BY 1")
oracle("cluster_event_daily", "SELECT CAST(event_time AS DATE) AS day, COUNT(*) AS event_count FROM v_cl_events GROUP BY 1")
oracle("busiest_clusters", "SELECT cluster_id, COUNT(*) AS total_events FROM v_cl_events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
oracle("health_summary", f"""SELECT COUNT(*) AS total_events, COUNT(DISTINCT cluster_id) AS unique_clusters, COUNT(*) FILTER ({FAILT}) AS failure_events, COUNT(*) FILTER ({SCALET}) AS scale_events, (SELECT COUNT(*) FILTER (avg_cpu_pct > 70) FROM v_cl_util) AS high_cpu_clusters,
  (SELECT COUNT(*) FILTER (avg_mem_pct > 80) FROM v_cl_util) AS high_mem_clusters FROM v_cl_events""")

# ---- platform, marketplace ----


def known(c: str, word: str = "unknown") -> str:
    return f"CASE WHEN COALESCE({c}, '') = '' THEN '{word}' ELSE {c} END AS {c}"


DERIVED["pe"] = "SELECT workspace_id, endpoint_name, private_endpoint_id AS endpoint_id, resource_id, group_id AS sub_resource_target, fqdn AS domain, COALESCE(state, '') AS status FROM v_private_endpoint_rules"
DERIVED["dash"] = f"SELECT * FROM v_dashboard_events WHERE {ets_within(30, 'event_time')}"
BOARD = "CASE WHEN COALESCE(dashboard_name, '') = '' THEN dashboard_id ELSE dashboard_name END AS dashboard"
DERIVED["dash_day"] = "SELECT CAST(event_time AS DATE) AS day, COUNT(*) AS event_count FROM v_dash GROUP BY 1"
DERIVED["dash_top"] = f"SELECT {BOARD}, COUNT(*) AS views FROM v_dash GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"
DERIVED["dash_users"] = f"SELECT {known('user_id')}, COUNT(*) AS event_count FROM v_dash GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"
DERIVED["dash_types"] = "SELECT event_type, COUNT(*) AS event_count FROM v_dash GROUP BY 1"
DERIVED["dash_inv"] = "SELECT dashboard_id, name AS dashboard_name, owner_username AS owner, created_time AS created_at, updated_time AS updated_at FROM v_dashboards"
oracle("private_endpoints", "SELECT * FROM v_pe")
oracle("endpoint_status", f"SELECT {known('status')}, COUNT(*) AS row_count FROM v_pe GROUP BY 1")
oracle("endpoints_by_workspace", f"SELECT {known('workspace_id')}, COUNT(*) AS row_count FROM v_pe GROUP BY 1")
oracle("dashboard_daily", "SELECT * FROM v_dash_day")
oracle("top_dashboards", "SELECT * FROM v_dash_top")
oracle("top_dashboard_users", "SELECT * FROM v_dash_users")
oracle("dashboard_event_types", "SELECT * FROM v_dash_types")
oracle("dashboard_usage", "SELECT 'day' AS section, CAST(day AS VARCHAR) AS item, event_count FROM v_dash_day UNION ALL SELECT 'dashboard', dashboard, views FROM v_dash_top UNION ALL SELECT 'user', user_id, event_count FROM v_dash_users UNION ALL SELECT 'type', event_type, event_count FROM v_dash_types")
oracle("dashboard_inventory", "SELECT * FROM v_dash_inv")
oracle("alert_states", f"SELECT {known('state')}, COUNT(*) AS row_count FROM v_sql_alerts GROUP BY 1")
oracle("platform_summary", "SELECT COUNT(*) AS dashboard_events, COUNT(DISTINCT CASE WHEN COALESCE(user_id, '') = '' THEN 'unknown' ELSE user_id END) AS unique_dash_users, (SELECT COUNT(*) FROM v_pe) AS private_endpoints, (SELECT COUNT(*) FROM v_dashboards) AS dashboards, (SELECT COUNT(*) FROM v_sql_alerts) AS active_alerts FROM v_dash")
DERIVED["lst"] = f"SELECT event_ref, listing_id, listing_name, event_type, event_time, consumer_workspace_id FROM v_listing_events WHERE {ets_within(90, 'event_time')}"
DERIVED["cons"] = "SELECT * FROM v_consumer_listings"
DERIVED["prov"] = "SELECT * FROM v_provider_listings"
oracle("listing_events", "SELECT * FROM v_lst")
oracle("listing_event_types", "SELECT event_type, COUNT(*) AS event_count FROM v_lst GROUP BY 1")
oracle("listing_daily", "SELECT CAST(event_time AS DATE) AS day, COUNT(*) AS event_count FROM v_lst GROUP BY 1")
oracle("consumer_listings", "SELECT * FROM v_cons")
oracle("provider_listings", "SELECT * FROM v_prov")
oracle("top_providers", f"SELECT {known('provider_name')}, COUNT(*) AS listings FROM v_cons GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
oracle("listing_types", f"SELECT {known('listing_type', 'UNKNOWN')}, COUNT(*) AS listings FROM v_cons GROUP BY 1")
oracle("marketplace_summary", "SELECT COUNT(*) AS listing_events, COUNT(DISTINCT event_type) AS unique_event_types, (SELECT COUNT(*) FROM v_cons) AS consumer_listings, (SELECT COUNT(*) FROM v_prov) AS provider_listings, (SELECT COUNT(DISTINCT COALESCE(provider_name, 'unknown')) FROM v_cons) AS unique_providers FROM v_lst")

# ---- cloud cost ----
CW = within(30)
CC = f"{r('SUM(cost_usd)', 2)} AS cost_usd"
oracle("cloud_filter", f"SELECT 'one' AS filter, COUNT(*) AS row_count, {CC} FROM v_cloud_costs WHERE {CW} AND cloud_provider = 'aws' AND account_id IN ('acct-0', 'acct-3') UNION ALL SELECT 'unknown', COUNT(*), {CC} FROM v_cloud_costs WHERE {CW}")
oracle("cloud_providers", "SELECT cloud_provider, COUNT(*) AS row_count FROM v_cloud_costs GROUP BY 1")
oracle("cloud_accounts", "SELECT cloud_provider, account_id, MAX(account_name) AS account_name FROM v_cloud_costs GROUP BY 1, 2")
oracle("cloud_summary", f"""
WITH s AS (SELECT {r(f'COALESCE(SUM(cost_usd) FILTER (usage_date >= {day(30)}), 0)', 2)} AS total_cost_usd, {r(f'COALESCE(SUM(cost_usd) FILTER (usage_date < {day(30)}), 0)', 2)} AS prev_cost_usd, COUNT(DISTINCT account_id) FILTER (usage_date >= {day(30)}) AS account_count,
  COUNT(DISTINCT service_name) FILTER (usage_date >= {day(30)}) AS service_count, COUNT(DISTINCT region) FILTER (usage_date >= {day(30)}) AS region_count, MAX(usage_date) FILTER (usage_date >= {day(30)}) AS latest_date, MIN(usage_date) FILTER (usage_date >= {day(30)}) AS earliest_date
  FROM v_cloud_costs WHERE {within(60)})
SELECT *, COALESCE({r('(total_cost_usd - prev_cost_usd) * 100 / NULLIF(prev_cost_usd, 0)', 1)}, 0.0) AS mom_pct FROM s""")
oracle("cloud_daily", f"SELECT usage_date, cloud_provider, {CC} FROM v_cloud_costs WHERE {CW} GROUP BY 1, 2")
oracle("cloud_by_service", f"SELECT service_name, service_category, cloud_provider, {CC}, COUNT(DISTINCT account_id) AS account_count FROM v_cloud_costs WHERE {CW} GROUP BY 1, 2, 3 ORDER BY cost_usd DESC, service_name, service_category, cloud_provider LIMIT 20")
oracle("cloud_by_account", f"SELECT cloud_provider, account_id, MAX(account_name) AS account_name, {CC}, COUNT(DISTINCT service_name) AS service_count, COUNT(DISTINCT region) AS region_count FROM v_cloud_costs WHERE {CW} GROUP BY 1, 2")
oracle("cloud_by_region", f"SELECT cloud_provider, region, {CC} FROM v_cloud_costs WHERE {CW} GROUP BY 1, 2")
oracle("cloud_by_sku", f"""SELECT cloud_provider, service_name, service_category, sku_description, usage_unit, pricing_model, {r('SUM(usage_quantity)', 2)} AS total_quantity, {r('AVG(CAST(unit_price AS DOUBLE))', 8)} AS avg_unit_price, {CC}, COUNT(DISTINCT account_id) AS account_count
FROM v_cloud_costs WHERE {CW} GROUP BY 1, 2, 3, 4, 5, 6 ORDER BY cost_usd DESC, 1, 2, 3, 4, 5, 6 LIMIT 30""")
oracle("cloud_by_category", f"SELECT service_category, cloud_provider, {CC} FROM v_cloud_costs WHERE {CW} GROUP BY 1, 2")
oracle("cloud_verify", f"SELECT cloud_provider, pricing_model, COUNT(*) AS row_count, {r('SUM(cost_usd)', 2)} AS total_usd FROM v_cloud_costs GROUP BY 1, 2")
