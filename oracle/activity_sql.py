from oracle.sql import COST, DERIVED, eday, ets_within, oracle, pct, r, within

# ---- adoption ----
KNOWN = "user_email IS NOT NULL AND trim(user_email) <> ''"
A90 = f"event_date BETWEEN {eday(90)} AND {eday()} AND {KNOWN}"
A30 = f"event_date BETWEEN {eday(30)} AND {eday()} AND {KNOWN}"
DERIVED["activity"] = f"""SELECT user_email, MAX(event_time) AS last_active, COUNT(*) AS action_count, COUNT(DISTINCT event_date) AS active_days, COUNT(DISTINCT workspace_id) AS workspaces_accessed, COUNT(DISTINCT service_name) AS services_used
FROM v_audit WHERE {A90} GROUP BY 1"""
DERIVED["top_service"] = f"""SELECT user_email, service_name AS top_service FROM (SELECT user_email, service_name, row_number() OVER (PARTITION BY user_email ORDER BY COUNT(*) DESC, service_name) AS rn FROM v_audit WHERE {A90} GROUP BY 1, 2) WHERE rn = 1"""
DERIVED["user_classes"] = """SELECT a.*, t.top_service, regexp_matches(replace(replace(split_part(lower(trim(a.user_email)), '@', 1), '-', ''), '_', ''), '^[0-9]+$')
  OR regexp_matches(split_part(lower(trim(a.user_email)), '@', 1), '^([^-]{4}|[^-]{8}|[^-]{12})(-([^-]{4}|[^-]{8}|[^-]{12})){4}$') AS is_service_principal FROM v_activity a LEFT JOIN v_top_service t USING (user_email)"""
oracle("user_activity", "SELECT * FROM v_activity")
oracle("daily_active_users", f"SELECT event_date, COUNT(DISTINCT user_email) AS active_users, COUNT(*) AS total_actions FROM v_audit WHERE {A90} GROUP BY 1")
# Sketches of so few users are exact.
oracle("active_users_sketched", f"""SELECT COUNT(DISTINCT user_email) FILTER (event_date >= {eday(1)}) AS active_1d, COUNT(DISTINCT user_email) FILTER (event_date >= {eday(7)}) AS active_7d, COUNT(DISTINCT user_email) AS active_30d,
  COUNT(DISTINCT service_name) AS services_30d, COUNT(*) AS total_actions FROM v_audit WHERE {A30}""")
oracle("service_breakdown", f"SELECT service_name, COUNT(*) AS action_count, COUNT(DISTINCT user_email) AS unique_users FROM v_audit WHERE {A30} GROUP BY 1")
oracle("top_actions", f"SELECT service_name, action_name, COUNT(*) AS action_count, COUNT(DISTINCT user_email) AS unique_users FROM v_audit WHERE {A30} GROUP BY 1, 2 ORDER BY action_count DESC, service_name, action_name LIMIT 50")
oracle("user_top_service", "SELECT * FROM v_top_service")
oracle("user_classes", "SELECT * FROM v_user_classes")
IDLE = f"date_diff('day', CAST(last_active AS DATE), {eday()})"
oracle("inactive_users", f"SELECT *, CAST({IDLE} AS INTEGER) AS days_inactive FROM v_user_classes WHERE NOT is_service_principal AND {IDLE} > 30")
oracle("adoption_summary", f"""SELECT COUNT(*) FILTER (NOT is_service_principal) AS total_users, COUNT(*) FILTER (NOT is_service_principal AND {IDLE} <= 7) AS active_7d, COUNT(*) FILTER (NOT is_service_principal AND {IDLE} <= 30) AS active_30d,
  COUNT(*) FILTER (NOT is_service_principal AND {IDLE} > 30) AS inactive, COUNT(*) FILTER (is_service_principal) AS service_principals FROM v_user_classes""")

# ---- AI usage ----
G30 = ets_within(30, "event_time")
TRAFFIC = f"COUNT(*) AS request_count, CAST(SUM(total_token_count) AS BIGINT) AS total_tokens, CAST(SUM(input_token_count) AS BIGINT) AS input_tokens, CAST(SUM(output_token_count) AS BIGINT) AS output_tokens, {r('AVG(execution_duration_ms)', 1)} AS avg_latency_ms"
DERIVED["gateway_days"] = f"SELECT route_name, CAST(event_time AS DATE) AS day, {TRAFFIC}, {r('CAST(SUM(total_token_count) AS DOUBLE) / 1000000', 3)} AS m_tokens FROM v_gateway_usage WHERE {G30} GROUP BY 1, 2"
DERIVED["gateway_users"] = f"SELECT requester AS user_email, {TRAFFIC}, COUNT(DISTINCT route_name) AS routes_used FROM v_gateway_usage WHERE {G30} AND requester IS NOT NULL GROUP BY 1"
DERIVED["serving_rows"] = f"SELECT * FROM v_priced WHERE {within(30)} AND (contains(sku_name, 'FOUNDATION_MODEL') OR contains(sku_name, 'MODEL_SERVING'))"
DERIVED["serving_days"] = f"SELECT sku_name, workspace_id, usage_date, {r('SUM(usage_quantity)', 4)} AS units, {r('SUM(cost)', 4)} AS cost FROM v_serving_rows GROUP BY 1, 2, 3"
oracle("gateway_usage", "SELECT * FROM v_gateway_days")
oracle("gateway_by_user", "SELECT * FROM v_gateway_users")
oracle("serving_billing", "SELECT * FROM v_serving_days")
oracle("latency_percentiles", f"""
SELECT route_name, COUNT(*) AS request_count, {r('quantile_cont(execution_duration_ms, 0.5)', 1)} AS p50_ms, {r('quantile_cont(execution_duration_ms, 0.9)', 1)} AS p90_ms, {r('quantile_cont(execution_duration_ms, 0.99)', 1)} AS p99_ms,
  {r('AVG(execution_duration_ms)', 1)} AS avg_ms, {r('MAX(execution_duration_ms)', 1)} AS max_ms, {pct('COUNT(*) FILTER (COALESCE(output_token_count, 0) = 0)', 'COUNT(*)', 2)} AS error_rate_pct FROM v_gateway_usage WHERE {G30} GROUP BY 1""")
oracle("latency_sketched", f"SELECT route_name, COUNT(*) AS request_count, TRUE AS p50_ms_in_bound, TRUE AS p90_ms_in_bound, TRUE AS p99_ms_in_bound FROM v_gateway_usage WHERE {G30} GROUP BY 1")
oracle("latency_daily", f"SELECT CAST(event_time AS DATE) AS day, COUNT(*) AS request_count, {r('quantile_cont(execution_duration_ms, 0.5)', 1)} AS p50_ms, {r('quantile_cont(execution_duration_ms, 0.9)', 1)} AS p90_ms FROM v_gateway_usage WHERE {G30} GROUP BY 1")
oracle("serving_by_user", f"SELECT COALESCE(run_as, 'unknown') AS user_email, sku_name, {r('SUM(usage_quantity)', 4)} AS units, {r('SUM(cost)', 4)} AS cost, COUNT(DISTINCT usage_date) AS active_days, COUNT(DISTINCT workspace_id) AS workspaces FROM v_serving_rows GROUP BY 1, 2")
oracle("gateway_daily", f"SELECT day, CAST(SUM(request_count) AS BIGINT) AS requests, CAST(SUM(total_tokens) AS BIGINT) AS total_tokens, {r('SUM(m_tokens)', 3)} AS m_tokens FROM v_gateway_days GROUP BY 1")
oracle("model_breakdown", f"""SELECT route_name AS model, CAST(SUM(request_count) AS BIGINT) AS requests, CAST(SUM(total_tokens) AS BIGINT) AS total_tokens, CAST(SUM(input_tokens) AS BIGINT) AS input_tokens, CAST(SUM(output_tokens) AS BIGINT) AS output_tokens,
  {r('SUM(avg_latency_ms * request_count) / SUM(request_count)', 1)} AS avg_latency_ms FROM v_gateway_days GROUP BY 1""")
oracle("serving_trend", f"SELECT usage_date, {r('SUM(units)', 4)} AS units, {r('SUM(cost)', 4)} AS cost FROM v_serving_days GROUP BY 1")
oracle("serving_skus", f"SELECT sku_name, {r('SUM(units)', 4)} AS units, {r('SUM(cost)', 4)} AS cost FROM v_serving_days GROUP BY 1")
oracle("ai_summary", f"""SELECT COUNT(*) AS total_requests, CAST(COALESCE(SUM(total_token_count), 0) AS BIGINT) AS total_tokens, {r('CAST(COALESCE(SUM(total_token_count), 0) AS DOUBLE) / 1000000', 2)} AS total_m_tokens, COUNT(DISTINCT route_name) AS models_in_use,
  (SELECT COALESCE({r('SUM(cost)', 2)}, 0.0) FROM v_serving_rows) AS total_serving_cost, COUNT(DISTINCT requester) AS gateway_users FROM v_gateway_usage WHERE {G30}""")

# ---- access ----
DERIVED["cat_grants"] = "SELECT trim(grantee) AS grantee, trim(catalog_name) AS catalog_name, trim(privilege_type) AS privilege_type FROM v_catalog_privileges WHERE trim(grantee) <> '' AND trim(catalog_name) <> '' AND privilege_type IS NOT NULL"
DERIVED["grants"] = """
SELECT g.*, COALESCE(i.n, m.n, g.grantee) AS principal FROM (SELECT grantee, catalog_name, privilege_type, NULL AS schema_name FROM v_cat_grants UNION ALL SELECT grantee, catalog_name, privilege_type, schema_name FROM v_schema_privileges) g
LEFT JOIN (SELECT user_id AS k, email AS n FROM v_users UNION ALL SELECT group_id, group_name FROM v_groups) i ON g.grantee = i.k
LEFT JOIN (SELECT lower(email) AS k, email AS n FROM v_users UNION ALL SELECT lower(group_name), group_name FROM v_groups) m ON lower(g.grantee) = m.k"""
DERIVED["assigned"] = "SELECT COALESCE(group_name, service_principal_name, user_name) AS principal, group_name IS NOT NULL AS is_group, workspace_id, permission FROM v_workspace_assignments"
DERIVED["ptypes"] = """
SELECT principal, CASE MAX(k) WHEN 3 THEN 'group' WHEN 2 THEN 'user' WHEN 1 THEN 'group' ELSE 'unknown' END AS principal_type FROM (
  SELECT email AS principal, 2 AS k FROM v_users UNION ALL SELECT group_name, 3 FROM v_groups UNION ALL SELECT principal, CASE WHEN is_group THEN 1 ELSE 0 END FROM v_assigned UNION ALL SELECT principal, 0 FROM v_grants) GROUP BY 1"""
DERIVED["memberships"] = "SELECT member, group_name FROM v_group_members UNION SELECT email, 'account users' FROM v_users"
oracle("catalog_grants", "SELECT * FROM v_cat_grants")
oracle("catalog_discovery", "SELECT DISTINCT trim(catalog_name) AS catalog_name FROM (SELECT catalog_name FROM v_catalogs UNION ALL SELECT catalog_name FROM v_catalog_privileges) WHERE NOT starts_with(trim(catalog_name), '__')")
oracle("schema_grants", "SELECT grantee, catalog_name, schema_name, privilege_type FROM v_schema_privileges")
oracle("row_filters", "SELECT * FROM v_row_filters")
oracle("column_masks", "SELECT * FROM v_column_masks")
oracle("join_principal_resolve", "SELECT grantee, principal, COUNT(*) AS grants FROM v_grants GROUP BY 1, 2")
oracle("principal_map", """
SELECT f.*, t.principal_type FROM (
  SELECT member AS principal, 'group' AS fact, group_name AS object, NULL AS detail FROM v_memberships UNION ALL SELECT group_name, 'member', member, NULL FROM v_group_members
  UNION ALL SELECT group_name, 'entitlement', entitlement, NULL FROM v_group_entitlements UNION ALL SELECT principal, 'workspace', workspace_id, permission FROM v_assigned
  UNION ALL SELECT principal, CASE WHEN schema_name IS NULL THEN 'catalog_grant' ELSE 'schema_grant' END, concat_ws('.', catalog_name, schema_name), privilege_type FROM v_grants) f LEFT JOIN v_ptypes t USING (principal)""")
oracle("principal_summary", """
SELECT t.principal, t.principal_type, COALESCE(g.catalog_count, 0) AS catalog_count, COALESCE(g.schema_count, 0) AS schema_count, COALESCE(g.privilege_types, '') AS privilege_types, COALESCE(g.total_grants, 0) AS total_grants, COALESCE(a.workspace_count, 0) AS workspace_count
FROM v_ptypes t LEFT JOIN (SELECT principal, COUNT(DISTINCT catalog_name) AS catalog_count, COUNT(DISTINCT CASE WHEN schema_name IS NOT NULL THEN concat(catalog_name, '.', schema_name) END) AS schema_count,
  string_agg(DISTINCT privilege_type, ',' ORDER BY privilege_type) AS privilege_types, COUNT(*) AS total_grants FROM v_grants GROUP BY 1) g USING (principal)
LEFT JOIN (SELECT principal, COUNT(*) AS workspace_count FROM v_assigned GROUP BY 1) a USING (principal)""")
oracle("access_summary", "SELECT COUNT(*) FILTER (principal_type = 'user') AS total_users, COUNT(*) FILTER (principal_type = 'group') AS total_groups, COUNT(*) AS total_principals, (SELECT COUNT(*) FROM v_row_filters) AS row_filters, (SELECT COUNT(*) FROM v_column_masks) AS column_masks FROM v_ptypes")
oracle("permission_edges", """
SELECT member AS src, 'user' AS src_type, group_name AS dst, 'group' AS dst_type, 'MEMBER' AS privilege FROM v_memberships
UNION SELECT principal, principal_type, concat_ws('.', catalog_name, schema_name), CASE WHEN schema_name IS NULL THEN 'catalog' ELSE 'schema' END, privilege_type FROM v_grants LEFT JOIN v_ptypes USING (principal)
UNION SELECT catalog_name, 'catalog', concat(catalog_name, '.', schema_name), 'schema', 'CONTAINS' FROM v_grants WHERE schema_name IS NOT NULL""")
oracle("grants_per_catalog", """
WITH g AS (SELECT * FROM v_cat_grants WHERE NOT starts_with(catalog_name, '__')), c AS (SELECT catalog_name, COUNT(*) AS grant_count FROM g GROUP BY 1)
SELECT g.catalog_name, g.grantee AS principal, g.privilege_type AS action, COUNT(*) AS times, MIN(c.grant_count) AS grant_count FROM g JOIN c USING (catalog_name) GROUP BY 1, 2, 3""")

# ---- governance ----
E30 = ets_within(30, "event_time")
DERIVED["gov"] = f"SELECT event_id, event_time, workspace_id, service_name, action_name, COALESCE(user_email, '') AS actor, request_params FROM v_audit WHERE {E30}"
DERIVED["iam"] = f"""SELECT * FROM v_gov WHERE service_name IN ('iamService', 'accountsManager', 'tokenManagement', 'groups', 'servicePrincipals', 'users', 'permissions', 'iam', 'accounts')
  OR action_name IN ('createServicePrincipal', 'createToken', 'revokeToken', 'changePermissions', 'updateGroup', 'addPrincipalToGroup') """
COLS = "event_id, event_time, workspace_id, action_name, actor"
DERIVED["sp_ev"] = f"SELECT {COLS} FROM v_gov WHERE action_name = 'createServicePrincipal'"
DERIVED["token_ev"] = f"SELECT {COLS} FROM v_gov WHERE action_name IN ('createToken', 'deleteToken', 'revokeToken')"
PARAMS = "request_params NOT LIKE '%}'"
WHOLE = f"CASE WHEN NOT ({PARAMS}) THEN request_params END"
PRINCIPAL = f"CAST(NULLIF(regexp_extract({WHOLE}, '\"id\": ([0-9]+)', 1), '') AS BIGINT) AS principal_id"
BROKEN = f"COALESCE({PARAMS}, FALSE) AS params_broken"
DERIVED["group_ev"] = f"SELECT {COLS}, NULLIF(regexp_extract({WHOLE}, '\"groupName\": \"([^\"]*)\"', 1), '') AS group_name, {PRINCIPAL}, NULLIF(regexp_extract({WHOLE}, '\"kind\": \"([^\"]*)\"', 1), '') AS principal_kind, {BROKEN} FROM v_gov WHERE action_name IN ('updateGroup', 'addPrincipalToGroup')"
DERIVED["perm_ev"] = f"SELECT {COLS}, NULLIF(regexp_extract({WHOLE}, '\"object\": \"([^\"]*)\"', 1), '') AS object, NULLIF(regexp_extract({WHOLE}, '\"level\": \"([^\"]*)\"', 1), '') AS level, {PRINCIPAL}, {BROKEN} FROM v_gov WHERE action_name = 'changePermissions'"
oracle("iam_events", "SELECT * EXCLUDE (request_params) FROM v_iam")
for key, view in (("sp_events", "sp_ev"), ("token_events", "token_ev"), ("group_events", "group_ev"), ("permission_events", "perm_ev")):
    oracle(key, f"SELECT * FROM v_{view}")
oracle("token_summary", "SELECT COUNT(*) FILTER (action_name = 'createToken') AS creates, COUNT(*) FILTER (action_name <> 'createToken') AS deletes FROM v_token_ev")
oracle("group_summary", "SELECT COUNT(*) FILTER (action_name = 'addPrincipalToGroup') AS adds, COUNT(*) FILTER (action_name <> 'addPrincipalToGroup') AS removes FROM v_group_ev")
oracle("iam_top_actions", "SELECT action_name, COUNT(*) AS event_count FROM v_iam GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
ACTOR = "CASE WHEN actor = '' THEN 'unknown' ELSE actor END"
oracle("iam_top_actors", f"SELECT {ACTOR} AS actor, COUNT(*) AS event_count FROM v_iam GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
oracle("iam_daily", "SELECT CAST(event_time AS DATE) AS day, COUNT(*) AS event_count FROM v_iam GROUP BY 1")
oracle("governance_summary", f"""SELECT COUNT(*) AS total_iam_events, COUNT(DISTINCT {ACTOR}) AS unique_actors, COUNT(DISTINCT action_name) AS unique_actions, (SELECT COUNT(*) FROM v_token_ev) AS token_events, (SELECT COUNT(*) FROM v_group_ev) AS group_events,
  (SELECT COUNT(*) FROM v_perm_ev) AS permission_events, (SELECT COUNT(*) FROM v_sp_ev) AS sp_count, (SELECT COUNT(*) FROM v_groups) AS group_count FROM v_iam""")
