from oracle.anomaly_sql import CRIT, WARN
from oracle.cost_sql import ENV, FINE, PATH
from oracle.sql import COST, DERIVED, UNITS, day, oracle, r, within
from spendscope.sources.testdata import VIEWS

W30 = within(30)

# ---- filters and labels ----
UW = f"SELECT workspace_id, COUNT(*) AS row_count, {UNITS}"
oracle("filter_usage", f"{UW} FROM v_usage_flat JOIN v_workspaces w USING (workspace_id) WHERE {within(365)} AND workspace_id IN ('ws-0', 'ws-4', 'ws-8', 'ws-12') AND lower(w.subscription_id) = 'sub-0' AND tag_env = 'prod' GROUP BY 1")
oracle("scope_workspaces", f"{UW} FROM v_usage_flat WHERE {W30} AND workspace_id IN (SELECT workspace_id FROM v_workspaces WHERE region = 'EUROPE') GROUP BY 1")
oracle("scope_subscription", f"{UW} FROM v_usage_flat WHERE {W30} AND workspace_id IN (SELECT workspace_id FROM v_workspaces WHERE lower(subscription_id) IN ('sub-1', 'sub-3') AND lower(resource_group) = 'rg-3') GROUP BY 1")
oracle("filter_tag", f"SELECT 'present' AS filter, COUNT(*) AS row_count FROM v_usage_flat WHERE {W30} AND tag_env IS NOT NULL UNION ALL SELECT 'equals', COUNT(*) FROM v_usage_flat WHERE {W30} AND tag_env = 'dev'")
CAT = "CASE WHEN contains(sku_name, 'ALL_PURPOSE') THEN 'All Purpose Compute' WHEN contains(sku_name, 'JOBS') THEN 'Jobs Compute' WHEN contains(sku_name, 'SQL') THEN 'SQL Warehouse' WHEN contains(sku_name, 'DLT') THEN 'Delta Live Tables' WHEN contains(sku_name, 'SERVING') THEN 'Model Serving' ELSE 'Other' END"
TYPE = "CASE WHEN contains(sku_name, 'ALL_PURPOSE') THEN 'cluster' WHEN contains(sku_name, 'SQL') THEN 'warehouse' WHEN contains(sku_name, 'JOBS') THEN 'job' WHEN contains(sku_name, 'DLT') THEN 'pipeline' ELSE 'other' END"
LABEL = "CASE billing_origin_product WHEN 'JOBS' THEN 'Jobs Compute' WHEN 'SQL' THEN 'SQL Warehouses' WHEN 'DLT' THEN 'Delta Live Tables' WHEN 'ALL_PURPOSE' THEN 'Interactive Clusters' ELSE 'Model Serving' END"
for key, expr, name in (("product_category", CAT, "product_category"), ("product_category_fine", FINE, "product_category"), ("resource_type", TYPE, "resource_type"), ("ai_sku_filter", "contains(sku_name, 'FOUNDATION_MODEL')", "is_ai")):
    oracle(key, f"SELECT sku_name, COUNT(*) AS row_count, {expr} AS {name} FROM v_usage_flat GROUP BY sku_name")
oracle("origin_product_label", f"SELECT billing_origin_product, COUNT(*) AS row_count, {LABEL} AS label FROM v_usage_flat GROUP BY billing_origin_product")
oracle("infra_category", f"SELECT billing_origin_product, COUNT(*) AS row_count, replace({LABEL}, 'Jobs Compute', 'Jobs') AS label FROM v_usage_flat GROUP BY billing_origin_product")
oracle("resource_id", f"SELECT COALESCE(cluster_id, warehouse_id, job_run_id, dlt_pipeline_id) AS resource_id, COUNT(*) AS row_count FROM v_usage_flat GROUP BY 1")
oracle("tag_alias", f"SELECT COALESCE(tag_product_name, tag_product) AS product_tag, tag_env AS env_tag, CAST(NULL AS VARCHAR) AS subscription_tag, CAST(NULL AS VARCHAR) AS resource_group_tag, COUNT(*) AS row_count FROM v_usage_flat GROUP BY 1, 2")
oracle("env_tier", "SELECT resource_id, name, tier, label, source FROM v_env")
oracle("env_from_workspace", f"SELECT workspace_id, {ENV.replace('w.', '')} AS environment FROM v_workspaces")
oracle("prod_workspace_filter", f"{UW} FROM v_usage_flat JOIN v_workspaces w USING (workspace_id) WHERE lower(w.workspace_name) LIKE '%prod%' GROUP BY 1")
oracle("prod_tag_filter", "SELECT workspace_id, COUNT(*) AS versions, COUNT(DISTINCT job_id) AS jobs FROM v_jobs WHERE tag_env IN ('prod', 'production', 'prd') GROUP BY 1")
oracle("resource_path", f"""
WITH d AS (SELECT DISTINCT sku_name, cluster_id, warehouse_id, job_id, job_run_id, dlt_pipeline_id, CAST(NULL AS VARCHAR) AS notebook_id, endpoint_name, CAST(NULL AS VARCHAR) AS endpoint_id FROM v_usage_flat),
e AS (SELECT *, {FINE} AS product FROM d) SELECT * EXCLUDE (product), {PATH} AS ui_path FROM e""")
oracle("is_service_principal", """SELECT user_email AS email, COUNT(*) AS row_count, COALESCE(user_email, '') = '' OR regexp_matches(replace(replace(split_part(lower(trim(user_email)), '@', 1), '-', ''), '_', ''), '^[0-9]+$') AS is_service_principal FROM v_audit GROUP BY user_email""")
oracle("severity_by_duration", f"""
WITH h AS (SELECT *, (epoch(TIMESTAMP '2001-08-01') - epoch(started_at)) / 3600.0 AS h FROM v_env)
SELECT resource_id, name, service_type, COALESCE(tier, 'other') AS tier, {r('h', 1)} AS hours, CASE WHEN h >= {CRIT} THEN 'critical' WHEN h >= {WARN} THEN 'warning' ELSE 'info' END AS severity FROM h""")
oracle("subscription_name", f"""
WITH n AS (SELECT lower(subscription_id) AS id, concat('Subscription of ', MIN(workspace_name)) AS nm FROM v_workspaces WHERE subscription_id <> 'sub-3' GROUP BY 1),
u AS (SELECT upper(subscription_id) AS subscription_id, {UNITS} FROM v_usage_flat JOIN v_workspaces USING (workspace_id) GROUP BY 1)
SELECT u.*, COALESCE(n.nm, u.subscription_id) AS subscription_name FROM u LEFT JOIN n ON lower(u.subscription_id) = n.id""")
oracle("infra_filter", f"SELECT usage_type, usage_type IN ('STORAGE_SPACE', 'NETWORK_BYTE', 'NETWORK_HOUR', 'API_OPERATION', 'TOKEN') AS is_infra, COUNT(*) AS row_count FROM v_usage_flat GROUP BY 1")
oracle("iam_filter", "SELECT service_name, action_name, COUNT(*) AS row_count, service_name IN ('iamService', 'accounts') OR action_name IN ('createServicePrincipal', 'createToken', 'revokeToken', 'changePermissions', 'updateGroup', 'addPrincipalToGroup') AS is_iam FROM v_audit GROUP BY 1, 2")
oracle("human_filter", "SELECT user_email IS NOT NULL AND trim(user_email) <> '' AND NOT ends_with(user_email, '@vendor.example') AS is_human, COUNT(*) AS row_count FROM v_audit GROUP BY 1")
oracle("interactive_query_filter", "SELECT statement_type, executed_by IS NOT NULL AND trim(executed_by) <> '' AND statement_type <> 'OTHER' AND executed_by = executed_as AS is_interactive, COUNT(*) AS row_count FROM v_query_history GROUP BY 1, 2")

# ---- sources ----
oracle("src_catalog", " UNION ALL ".join(f"SELECT '{n}' AS table_name, COUNT(*) AS row_count FROM v_{flat}" for n, (flat, _) in sorted(VIEWS.items())))
oracle("src_missing_empty", "SELECT 'access.workspaces_latest' AS table_name, COUNT(*) AS row_count FROM v_workspaces UNION ALL SELECT 'networking.vpc_endpoints', 0")
oracle("src_column_drift", "SELECT endpoint_name, fqdn AS domain, COALESCE(state, '') AS status, '' AS region FROM v_private_endpoint_rules")
oracle("src_first_nonempty", "SELECT event_type, COUNT(*) AS row_count FROM v_dashboard_events GROUP BY 1")

# ---- ingestion ----
PRICE = "COALESCE(CAST(ROUND(CAST({c} / NULLIF({q}, 0) AS DECIMAL(28,12)), 8) AS DOUBLE), 0.0)"
TOT = f"COUNT(*) AS row_count, {r('SUM(CAST(q AS DECIMAL(18,4)))', 4)} AS usage_quantity, {r('SUM(CAST(up AS DECIMAL(18,8)))', 4)} AS unit_prices, {r('SUM(CAST(c AS DECIMAL(18,4)))', 4)} AS cost_usd"
DERIVED["az"] = f"SELECT 'azure' AS cloud_provider, subscription_id AS account_id, service_category, resource_location AS region, 'ON_DEMAND' AS pricing_model, COALESCE(currency, 'USD') AS currency, CAST(usage_day AS DATE) AS usage_date, usage_quantity AS q, cost AS c, {PRICE.format(c='cost', q='usage_quantity')} AS up FROM v_azure_export"
DERIVED["aw"] = f"""SELECT 'aws' AS cloud_provider, linked_account AS account_id, CASE service WHEN 'Amazon Elastic Compute Cloud' THEN 'Compute' WHEN 'AWS Lambda' THEN 'Serverless' WHEN 'Amazon DynamoDB' THEN 'Database' WHEN 'Amazon Redshift' THEN 'Analytics' WHEN 'Amazon Bedrock' THEN 'AI / ML' ELSE 'Other' END AS service_category,
  region, CASE WHEN contains(lower(usage_type), 'spot') THEN 'SPOT' WHEN contains(lower(usage_type), 'heavyusage') OR contains(lower(usage_type), 'partialupfront') THEN 'RESERVED_1Y' ELSE 'ON_DEMAND' END AS pricing_model, currency, CAST(usage_day AS DATE) AS usage_date,
  usage_quantity AS q, unblended_cost AS c, {PRICE.format(c='unblended_cost', q='usage_quantity')} AS up FROM v_aws_export"""
DERIVED["gc"] = f"""SELECT 'gcp' AS cloud_provider, project_id AS account_id, COALESCE(project_name, project_id) AS account_name, CASE service_description WHEN 'Compute Engine' THEN 'Compute' WHEN 'Cloud Run' THEN 'Serverless' WHEN 'BigQuery' THEN 'Analytics' WHEN 'Vertex AI' THEN 'AI / ML' ELSE 'Other' END AS service_category,
  region, 'ON_DEMAND' AS pricing_model, currency, q, c, {PRICE.format(c='c', q='q')} AS up FROM (
  SELECT project_id, project_name, CAST(usage_start_time AS DATE) AS d, service_description, sku_description, pricing_unit, COALESCE(location_region, location_name, 'global') AS region, currency, CAST(SUM(usage_amount) AS DOUBLE) AS q,
    CAST(SUM(cost) + SUM(COALESCE(credit_a, 0) + COALESCE(credit_b, 0)) AS DOUBLE) AS c FROM v_gcp_export GROUP BY 1, 2, 3, 4, 5, 6, 7, 8)"""
oracle("ingest_azure_costs", f"SELECT cloud_provider, account_id, service_category, region, pricing_model, currency, {TOT} FROM v_az GROUP BY 1, 2, 3, 4, 5, 6")
oracle("ingest_aws_costs", f"SELECT cloud_provider, account_id, service_category, region, pricing_model, currency, {TOT} FROM v_aw GROUP BY 1, 2, 3, 4, 5, 6")
oracle("ingest_gcp_costs", f"SELECT cloud_provider, account_id, account_name, service_category, region, pricing_model, currency, {TOT} FROM v_gc GROUP BY 1, 2, 3, 4, 5, 6, 7")
oracle("ingest_window", f"SELECT usage_date, COUNT(*) AS row_count FROM v_az WHERE usage_date BETWEEN {day(30)} AND {day(1)} GROUP BY 1")
oracle("ingest_cast", "SELECT usage_date, TIMESTAMP '2001-08-01 06:00:00' AS ingested_at, TRUE AS no_tags, COUNT(*) AS row_count FROM v_aw GROUP BY 1")
KEYS = "cloud_provider, account_id, usage_date, service_name, sku_description, region, resource_group"
DERIVED["keyed"] = f"SELECT {KEYS}, SUM(cost_usd) AS cost_usd FROM v_cloud_costs GROUP BY 1, 2, 3, 4, 5, 6, 7"
CT = f"COUNT(*) AS row_count, {r('SUM(cost_usd)', 2)} AS cost_usd"
oracle("sink_partitioned", f"SELECT cloud_provider, usage_date, {CT} FROM v_keyed GROUP BY 1, 2")
oracle("upsert_cloud_costs", f"""SELECT cloud_provider, usage_date, {CT} FROM (SELECT cloud_provider, usage_date, cost_usd * CASE WHEN {within(2)} THEN 2 ELSE 1 END AS cost_usd FROM v_keyed
  UNION ALL SELECT cloud_provider, usage_date, cost_usd * 2 FROM v_keyed WHERE {within(2)} AND account_id = 'acct-1') GROUP BY 1, 2""")
oracle("upsert_permissions", """
WITH p AS (SELECT lower(email) AS email, config, updated_at, updated_by, CAST(regexp_extract(email, '([0-9]+)@', 1) AS BIGINT) % 10 AS m FROM v_user_permissions)
SELECT email, CASE WHEN m = 0 THEN '{"tabs": ["audit"]}' ELSE config END AS config, CASE WHEN m = 0 THEN TIMESTAMP '2001-08-01 06:00:00' ELSE updated_at END AS updated_at, CASE WHEN m = 0 THEN 'owner@example.com' ELSE updated_by END AS updated_by FROM p WHERE m <> 2
UNION ALL SELECT concat('new-', email), '{"tabs": ["audit"]}', TIMESTAMP '2001-08-01 06:00:00', 'owner@example.com' FROM p WHERE m = 1""")
oracle("read_permissions", """
WITH p AS (SELECT lower(email) AS email, config, CAST(regexp_extract(email, '([0-9]+)@', 1) AS BIGINT) % 4 AS m FROM v_user_permissions)
SELECT email, m <> 3 AS is_valid, CASE m WHEN 0 THEN 'cost,query' WHEN 1 THEN 'executive' END AS tabs, CASE WHEN m = 0 THEN regexp_extract(config, '(ws-[0-9]+)', 1) END AS workspaces,
  CASE m WHEN 0 THEN 'Team' WHEN 1 THEN 'Product' END AS tag_key, CASE m WHEN 0 THEN regexp_extract(config, '"value": "([^"]*)"', 1) WHEN 1 THEN regexp_extract(config, '"Product": "([^"]*)"', 1) END AS tag_value FROM p""")

# ---- quality ----


def rule(name: str, view: str, ok: str) -> str:
    return f"SELECT '{name}' AS rule, COUNT(*) FILTER ({ok}) AS passed, COUNT(*) FILTER (NOT COALESCE({ok}, FALSE)) AS failed FROM v_{view}"


IDENT = "regexp_matches(lower(trim(user_email)), '^[a-z0-9][a-z0-9._\\-+]{0,127}@[a-z0-9][a-z0-9.\\-]{0,127}$')"
MAIL = "regexp_matches(lower(trim(user_email)), '^[a-z0-9][a-z0-9._+\\-]{0,127}@[a-z0-9][a-z0-9.\\-]{0,126}\\.[a-z]{2,}$')"
JSONOK = "config <> 'not json'"
# What the landing views put into their rows, not the patterns: a rule must find just these.
USAGE_RULES = {
    "usage.usage_date": f"usage_date BETWEEN {day(730)} AND {day(-1)}", "usage.workspace_id": "workspace_id IS NOT NULL AND workspace_id <> 'ws 1'",
    "usage.sku_name": "sku_name <> 'pro sql'", "usage.tag_keys": "tag_key <> 'Team!'", "usage.tag_values": "tag_value IS NULL OR tag_value = 'core'",
}
DERIVED["overlaps"] = """SELECT *, price_start_time < MAX(COALESCE(price_end_time, TIMESTAMP '9999-12-31')) OVER (PARTITION BY sku_name ORDER BY price_start_time, price_end_time NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM v_landing_prices"""
oracle("dq_validate", " UNION ALL ".join((
    *(rule(name, "landing_usage", ok) for name, ok in USAGE_RULES.items()),
    rule("audit.identity", "audit", IDENT), rule("audit.email", "audit", MAIL), rule("workspace.subscription", "landing_workspaces", "subscription_id <> 'sub 1'"),
    rule("workspace.resource_group", "landing_workspaces", "resource_group IS NOT NULL AND resource_group <> 'rg/1'"), rule("table.name", "landing_tables", "table_name <> 'bad name'"),
    rule("config.json", "landing_permissions", JSONOK), rule("config.tabs", "landing_permissions", "NOT contains(config, 'nope')"), rule("config.workspaces", "landing_permissions", "NOT contains(config, 'w s')"),
    rule("settings.threshold", "landing_settings", "threshold_pct IN ('20', '99.9')"), rule("settings.email", "landing_settings", "contains(email, '@')"),
    rule("prices.no_overlap", "overlaps", "o IS NOT TRUE"), rule("prices.window", "landing_prices", "price_end_time IS NULL OR price_end_time > price_start_time"))))
oracle("dq_quarantine", f"""SELECT record_id, concat_ws(',', {', '.join(f"CASE WHEN NOT COALESCE({ok}, FALSE) THEN '{name}' END" for name, ok in USAGE_RULES.items())}) AS broken_rules
FROM v_landing_usage WHERE NOT ({' AND '.join(f'COALESCE({ok}, FALSE)' for ok in USAGE_RULES.values())})""")
oracle("dq_rejects", f"SELECT event_id, user_email AS email, concat_ws(',', CASE WHEN NOT COALESCE({IDENT}, FALSE) THEN 'identity' END, CASE WHEN NOT COALESCE({MAIL}, FALSE) THEN 'email' END) AS broken_rules FROM v_audit WHERE NOT COALESCE({IDENT}, FALSE) OR NOT COALESCE({MAIL}, FALSE)")
oracle("unpriced_usage", f"SELECT sku_name, cloud, COUNT(*) AS row_count, {UNITS} FROM v_priced WHERE {W30} AND NOT is_priced GROUP BY 1, 2")
for key in ("join_effective_price", "join_price_binned"):
    oracle(key, f"SELECT sku_name, cloud, {r('COALESCE(cost / NULLIF(usage_quantity, 0), 0)', 6)} AS price, COUNT(*) AS row_count, {UNITS}, {COST} FROM v_priced GROUP BY 1, 2, 3")
oracle("visible_usage", f"""
WITH p AS (SELECT lower(email) AS email, CASE WHEN CAST(regexp_extract(email, '([0-9]+)@', 1) AS BIGINT) % 4 = 0 THEN regexp_extract(config, '(ws-[0-9]+)', 1) END AS ws FROM v_user_permissions),
t AS (SELECT workspace_id, COUNT(*) AS n, CAST(SUM(usage_quantity) AS DECIMAL(28,4)) AS q FROM v_usage_flat GROUP BY 1)
SELECT email, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS row_count, COALESCE({r('SUM(q)', 2)}, 0.0) AS units FROM p LEFT JOIN t ON ws = t.workspace_id OR ws IS NULL GROUP BY 1""")
