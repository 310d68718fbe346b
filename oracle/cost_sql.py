from oracle.sql import COST, UNITS, day, oracle, r, within

W30 = within(30)
TODAY = f"usage_date = {day()}"

oracle("cost_summary", f"""
SELECT COUNT(DISTINCT workspace_id) AS workspace_count, COUNT(DISTINCT sku_name) AS product_count,
  COALESCE({r('SUM(usage_quantity)', 2)}, 0.0) AS units, COALESCE({r('SUM(cost)', 2)}, 0.0) AS cost FROM v_priced WHERE {W30}""")
oracle("cost_daily_trend", f"""
SELECT usage_date, product_category, {r('SUM(usage_quantity)', 4)} AS units, {COST} FROM v_priced WHERE {W30} GROUP BY 1, 2""")
oracle("cost_by_product", f"""
SELECT sku_name, product_category, {UNITS}, {COST}, COUNT(DISTINCT workspace_id) AS workspace_count FROM v_priced WHERE {W30} GROUP BY 1, 2""")
oracle("cost_by_workspace", f"""
SELECT workspace_id, {UNITS}, {COST}, COUNT(DISTINCT sku_name) AS product_count FROM v_priced WHERE {W30} GROUP BY 1
ORDER BY units DESC, workspace_id LIMIT 20""")
oracle("spike_by_workspace", f"""
SELECT u.*, w.workspace_name, w.workspace_url FROM (
  SELECT workspace_id, {UNITS}, {COST}, COUNT(DISTINCT sku_name) AS sku_count FROM v_priced WHERE {TODAY} GROUP BY 1) u
LEFT JOIN v_workspaces w USING (workspace_id)""")

FINE = """CASE WHEN sku_name LIKE '%SERVERLESS%' AND sku_name LIKE '%SQL%' THEN 'Serverless SQL' WHEN sku_name LIKE '%SERVERLESS%' AND sku_name LIKE '%JOBS%' THEN 'Serverless Jobs'
  WHEN contains(sku_name, 'ALL_PURPOSE') THEN 'Interactive Cluster' WHEN contains(sku_name, 'SQL') THEN 'SQL Warehouse' WHEN contains(sku_name, 'JOBS') THEN 'Jobs Cluster'
  WHEN contains(sku_name, 'DLT') THEN 'DLT Pipeline' WHEN contains(sku_name, 'FOUNDATION_MODEL') THEN 'Model Serving' ELSE 'Other' END"""
PATH = f"""CASE WHEN warehouse_id IS NOT NULL THEN concat('sql/warehouses/', warehouse_id) WHEN dlt_pipeline_id IS NOT NULL THEN concat('#joblist/pipelines/', dlt_pipeline_id)
  WHEN endpoint_name IS NOT NULL THEN concat('ml/endpoints/', endpoint_name) WHEN contains(product, 'Serving') THEN 'ml/endpoints'
  WHEN job_id IS NOT NULL AND job_run_id IS NOT NULL THEN concat('#job/', job_id, '/run/', job_run_id) WHEN job_id IS NOT NULL THEN concat('#job/', job_id)
  WHEN job_run_id IS NOT NULL THEN concat('#job/runs/', job_run_id)
  WHEN cluster_id IS NOT NULL THEN concat('#setting/clusters/', cluster_id, CASE WHEN contains(product, 'Jobs') THEN '/configuration' ELSE '' END) ELSE '' END"""
IDS = """MIN(cluster_id) AS cluster_id, MIN(warehouse_id) AS warehouse_id, MIN(job_id) AS job_id, MIN(job_run_id) AS job_run_id, MIN(dlt_pipeline_id) AS dlt_pipeline_id,
  CAST(NULL AS VARCHAR) AS notebook_id, MIN(endpoint_name) AS endpoint_name, CAST(NULL AS VARCHAR) AS endpoint_id, MIN(run_as) AS run_as"""

oracle("spike_resources", f"""
WITH g AS (SELECT workspace_id, resource_id, sku_name, {IDS}, {UNITS}, {COST} FROM v_priced WHERE {TODAY} AND resource_id IS NOT NULL GROUP BY 1, 2, 3),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY workspace_id ORDER BY cost DESC, resource_id, sku_name) AS INTEGER) AS rank, {FINE} AS product FROM g)
SELECT *, {PATH} AS ui_path FROM k WHERE rank <= 20""")
oracle("spike_by_product", f"""
SELECT u.*, w.workspace_name, w.resource_group FROM (SELECT sku_name, product_category, workspace_id, {UNITS}, {COST} FROM v_priced WHERE {TODAY} GROUP BY 1, 2, 3) u
LEFT JOIN v_workspaces w USING (workspace_id)""")
oracle("spike_top_resources", f"""
WITH g AS (SELECT workspace_id, resource_id, sku_name, {IDS}, {UNITS}, {COST} FROM v_priced WHERE {TODAY} GROUP BY 1, 2, 3
  ORDER BY cost DESC, workspace_id, resource_id NULLS LAST, sku_name LIMIT 30),
k AS (SELECT *, {FINE} AS product FROM g)
SELECT k.*, {PATH} AS ui_path, w.workspace_name, w.resource_group FROM k LEFT JOIN v_workspaces w USING (workspace_id)""")
oracle("spike_by_job", f"""
WITH g AS (SELECT job_id, workspace_id, sku_name, COUNT(DISTINCT job_run_id) AS run_count, {UNITS}, {COST} FROM v_priced WHERE {TODAY} AND job_id IS NOT NULL GROUP BY 1, 2, 3)
SELECT g.*, j.name AS job_name, w.workspace_name FROM g LEFT JOIN v_jobs_latest j USING (workspace_id, job_id) LEFT JOIN v_workspaces w USING (workspace_id)""")
oracle("spike_job_runs", f"""
WITH g AS (SELECT job_id, workspace_id, sku_name, {COST} FROM v_priced WHERE {TODAY} AND job_id IS NOT NULL GROUP BY 1, 2, 3)
SELECT u.job_id, u.workspace_id, u.sku_name, u.job_run_id AS run_id, {UNITS}, {r('SUM(u.cost)', 2)} AS cost
FROM v_priced u JOIN g USING (job_id, workspace_id, sku_name) WHERE {TODAY} GROUP BY 1, 2, 3, 4""")
oracle("spike_totals", f"""
WITH g AS (SELECT workspace_id, {UNITS}, {COST} FROM v_priced WHERE {TODAY} GROUP BY 1)
SELECT COALESCE({r('SUM(cost)', 2)}, 0.0) AS cost, COALESCE({r('SUM(units)', 2)}, 0.0) AS units, COUNT(*) AS workspaces FROM g""")
oracle("cost_by_tag", f"""
SELECT tag_team AS tag_value, {UNITS}, {COST}, COUNT(DISTINCT workspace_id) AS workspace_count FROM v_priced WHERE {W30} AND tag_team IS NOT NULL GROUP BY 1 ORDER BY units DESC, tag_value LIMIT 20""")
ENV = """CASE WHEN lower(w.workspace_name) LIKE '%prod%' THEN 'prod' WHEN lower(w.workspace_name) LIKE '%uat%' THEN 'uat' WHEN lower(w.workspace_name) LIKE '%test%' THEN 'test'
  WHEN lower(w.workspace_name) LIKE '%dev%' THEN 'dev' ELSE 'other' END"""
oracle("cost_by_tag_env", f"""
SELECT tag_team AS tag_value, {ENV} AS environment, {UNITS}, {COST} FROM v_priced u LEFT JOIN v_workspaces w USING (workspace_id) WHERE {W30} AND tag_team IS NOT NULL GROUP BY 1, 2""")
oracle("tag_values", f"SELECT DISTINCT tag_team AS tag_value FROM v_usage_flat WHERE {within(90)} AND tag_team IS NOT NULL")
oracle("tag_keys", f"""
SELECT DISTINCT tag_key FROM (SELECT unnest([CASE WHEN tag_team IS NOT NULL THEN 'Team' END, CASE WHEN tag_product_name IS NOT NULL THEN 'ProductName' END,
  CASE WHEN tag_product IS NOT NULL THEN 'Product' END, CASE WHEN tag_env IS NOT NULL THEN 'Env' END]) AS tag_key FROM v_usage_flat WHERE {within(90)}) WHERE tag_key IS NOT NULL""")
oracle("filter_options", f"""
WITH d AS (SELECT a.workspace_id, w.workspace_name, w.subscription_id, w.resource_group FROM (SELECT DISTINCT workspace_id FROM v_usage_flat WHERE {within(90)}) a LEFT JOIN v_workspaces w USING (workspace_id))
SELECT 'workspace' AS kind, workspace_id AS id, COALESCE(workspace_name, workspace_id) AS name FROM d
UNION SELECT 'subscription', subscription_id, subscription_id FROM d WHERE subscription_id IS NOT NULL
UNION SELECT 'resource_group', resource_group, resource_group FROM d WHERE resource_group IS NOT NULL""")
oracle("resource_groups", "SELECT DISTINCT resource_group FROM v_workspaces WHERE subscription_id IN ('sub-1', 'sub-2')")
W1 = within(1)
oracle("billing_snapshot", f"""
SELECT resource_type, resource_id, MIN(usage_start_time) AS first_billing_time, {r('SUM(usage_quantity)', 3)} AS units, {COST} FROM (
  SELECT 'cluster' AS resource_type, cluster_id AS resource_id, usage_start_time, usage_quantity, cost FROM v_priced WHERE {W1} AND cluster_id IS NOT NULL
  UNION ALL SELECT 'warehouse', warehouse_id, usage_start_time, usage_quantity, cost FROM v_priced WHERE {W1} AND warehouse_id IS NOT NULL
  UNION ALL SELECT 'run', job_run_id, usage_start_time, usage_quantity, cost FROM v_priced WHERE {W1} AND job_run_id IS NOT NULL
  UNION ALL SELECT 'pipeline', dlt_pipeline_id, usage_start_time, usage_quantity, cost FROM v_priced WHERE {W1} AND dlt_pipeline_id IS NOT NULL) GROUP BY 1, 2""")
SESSION = f"""s AS (SELECT warehouse_id, usage_start_time, lag(usage_end_time) OVER (PARTITION BY warehouse_id ORDER BY usage_start_time, usage_end_time) AS prev_end
    FROM v_usage_flat WHERE {within(365)} AND warehouse_id IS NOT NULL),
b AS (SELECT warehouse_id, MAX(usage_start_time) AS session_start FROM s WHERE prev_end IS NULL OR epoch(usage_start_time) - epoch(prev_end) > 3600 GROUP BY 1)"""
oracle("warehouse_session", f"""
WITH {SESSION} SELECT b.warehouse_id, b.session_start, {r('SUM(usage_quantity)', 3)} AS units, {COST} FROM v_priced u JOIN b USING (warehouse_id)
WHERE {within(365)} AND u.usage_start_time >= b.session_start GROUP BY 1, 2""")
oracle("join_cross_scalar", f"""
WITH {SESSION} SELECT b.warehouse_id, b.session_start, COUNT(*) AS row_count FROM v_usage_flat u JOIN b USING (warehouse_id)
WHERE {within(365)} AND u.usage_start_time >= b.session_start GROUP BY 1, 2""")
oracle("job_cost_30d", f"""
WITH g AS (SELECT job_id, workspace_id, sku_name, COUNT(DISTINCT job_run_id) AS run_count, {UNITS}, {COST}, MIN(usage_start_time) AS first_run, MAX(usage_start_time) AS last_run,
  COUNT(DISTINCT usage_date) AS active_days FROM v_priced WHERE {W30} AND job_id IS NOT NULL GROUP BY 1, 2, 3)
SELECT g.*, j.name AS job_name, w.workspace_name FROM g LEFT JOIN v_jobs_latest j USING (workspace_id, job_id) LEFT JOIN v_workspaces w USING (workspace_id)""")
oracle("join_job_name", f"""
SELECT u.*, j.name AS job_name FROM (SELECT workspace_id, job_id, {UNITS} FROM v_usage_flat WHERE {W30} AND job_id IS NOT NULL GROUP BY 1, 2) u LEFT JOIN v_jobs_latest j USING (workspace_id, job_id)""")
oracle("semi_active_filters", f"""
SELECT subscription_id, COUNT(*) AS workspaces FROM v_workspaces WHERE workspace_id IN (SELECT workspace_id FROM v_usage_flat WHERE {within(90)}) GROUP BY 1""")
oracle("workspace_access", """
WITH p AS (SELECT workspace_id, CASE WHEN group_name IS NOT NULL THEN 'Group' WHEN service_principal_name IS NOT NULL THEN 'Service Principal' ELSE 'User' END AS principal_type,
  COALESCE(group_name, service_principal_name, user_name) AS principal, permission FROM v_workspace_assignments),
c AS (SELECT workspace_id, COUNT(DISTINCT concat(principal_type, '|', principal)) AS principal_count FROM p GROUP BY 1)
SELECT p.*, c.principal_count, w.workspace_name FROM p JOIN c USING (workspace_id) LEFT JOIN v_workspaces w USING (workspace_id)""")
oracle("workspace_groups", """
WITH e AS (SELECT DISTINCT group_name, CASE entitlement WHEN 'workspace-admin' THEN 'Workspace Admin' WHEN 'allow-cluster-create' THEN 'Can Create Clusters'
  WHEN 'allow-instance-pool-create' THEN 'Can Create Instance Pools' WHEN 'sql-access' THEN 'Sql Access' ELSE 'Custom Power User' END AS entitlement FROM v_group_entitlements),
m AS (SELECT group_name, COUNT(*) AS member_count FROM v_group_members GROUP BY 1)
SELECT g.group_name, COALESCE(m.member_count, 0) AS member_count, e.entitlement FROM v_groups g LEFT JOIN m USING (group_name) LEFT JOIN e USING (group_name)""")
oracle("workspace_users", "SELECT display_name, CASE WHEN email_is_primary THEN email ELSE other_email END AS email, active FROM v_users")
