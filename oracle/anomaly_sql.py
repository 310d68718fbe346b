from oracle.cost_sql import SESSION
from oracle.sql import COST, DERIVED, UNITS, change, day, eday, ets_within, oracle, r, within

# ---- running resources ----
DERIVED["event_session"] = f"""
WITH e AS (SELECT * FROM v_warehouse_events WHERE CAST(event_time AS DATE) <= {eday()}), s AS (SELECT warehouse_id, event_time FROM e WHERE event_type IN ('RUNNING', 'STARTING')),
m AS (SELECT warehouse_id, MAX(event_time) AS newest FROM s GROUP BY 1), t AS (SELECT e.warehouse_id, MAX(e.event_time) AS stop FROM e JOIN m USING (warehouse_id) WHERE e.event_type = 'STOPPED' AND e.event_time < m.newest GROUP BY 1)
SELECT s.warehouse_id, MIN(s.event_time) AS session_start FROM s LEFT JOIN t USING (warehouse_id) WHERE t.stop IS NULL OR s.event_time > t.stop GROUP BY 1"""
DERIVED["billing_session"] = f"""WITH {SESSION} SELECT b.warehouse_id, b.session_start, {r('SUM(usage_quantity)', 3)} AS units, {COST} FROM v_priced u JOIN b USING (warehouse_id) WHERE {within(365)} AND u.usage_start_time >= b.session_start GROUP BY 1, 2"""


def snap(kind: str, col: str) -> str:
    return f"SELECT '{kind}' AS k, {col} AS id, MIN(usage_start_time) AS first_ts, {r('SUM(usage_quantity)', 3)} AS units, {COST} FROM v_priced WHERE {within(1)} AND {col} IS NOT NULL GROUP BY 2"


DERIVED["snapshot"] = " UNION ALL ".join(snap(k, c) for k, c in (("Cluster", "cluster_id"), ("Job Run", "job_run_id"), ("DLT Pipeline", "dlt_pipeline_id")))
TIERS = (("dev", ("development", "sandbox", "nonprod", "dev")), ("test", ("testing", "staging", "stage", "test", "qa")), ("uat", ("uat",)), ("prod", ("production", "prod", "live", "prd")))


def scan(col: str, want: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({col}), '{w}') THEN '{t if want == 'tier' else w}'" for t, words in TIERS for w in words) + " END"


DERIVED["env"] = f"""
SELECT x.*, w.workspace_name, CASE WHEN tag_environment IS NOT NULL THEN 'prod' ELSE COALESCE({scan('x.name', 'tier')}, {scan('w.workspace_name', 'tier')}) END AS tier,
  CASE WHEN tag_environment IS NOT NULL THEN tag_environment ELSE COALESCE({scan('x.name', 'word')}, {scan('w.workspace_name', 'word')}) END AS label,
  CASE WHEN tag_environment IS NOT NULL THEN 'tag' WHEN {scan('x.name', 'tier')} IS NOT NULL THEN 'name' WHEN {scan('w.workspace_name', 'tier')} IS NOT NULL THEN 'workspace' END AS source
FROM v_running_resources x LEFT JOIN v_workspaces w USING (workspace_id)"""
DERIVED["running0"] = f"""
SELECT e.service_type, e.resource_id, e.name, e.workspace_id, e.workspace_name, e.tier, e.label, e.source,
  CASE e.service_type WHEN 'SQL Warehouse' THEN least(b.session_start, v.session_start) WHEN 'DLT Pipeline' THEN p.first_ts ELSE e.started_at END AS started_at,
  CASE e.service_type WHEN 'SQL Warehouse' THEN b.units ELSE p.units END AS units, CASE e.service_type WHEN 'SQL Warehouse' THEN b.cost ELSE p.cost END AS cost
FROM v_env e LEFT JOIN v_snapshot p ON e.service_type = p.k AND e.resource_id = p.id LEFT JOIN v_billing_session b ON e.service_type = 'SQL Warehouse' AND e.resource_id = b.warehouse_id
LEFT JOIN v_event_session v ON e.service_type = 'SQL Warehouse' AND e.resource_id = v.warehouse_id"""
CRIT = "CASE WHEN service_type = 'Job Run' THEN CASE tier WHEN 'dev' THEN 4 WHEN 'test' THEN 6 WHEN 'uat' THEN 8 WHEN 'prod' THEN 24 ELSE 4 END ELSE CASE tier WHEN 'dev' THEN 8 WHEN 'test' THEN 12 WHEN 'uat' THEN 24 WHEN 'prod' THEN 72 ELSE 8 END END"
WARN = "CASE WHEN service_type = 'Job Run' THEN CASE tier WHEN 'dev' THEN 2 WHEN 'test' THEN 3 WHEN 'uat' THEN 4 WHEN 'prod' THEN 8 ELSE 2 END ELSE CASE tier WHEN 'dev' THEN 4 WHEN 'test' THEN 6 WHEN 'uat' THEN 12 WHEN 'prod' THEN 48 ELSE 4 END END"
DERIVED["running"] = f"""
SELECT service_type, resource_id, name, workspace_id, workspace_name, COALESCE(label, 'unknown') AS environment, COALESCE(tier, 'other') AS env_tier, COALESCE(source, 'duration') AS detected_by, started_at, {r('h', 1)} AS duration_hours,
  CASE WHEN h >= 0 AND h >= {CRIT} THEN 'critical' WHEN h >= 0 AND h >= {WARN} THEN 'warning' ELSE 'info' END AS anomaly_level, units, cost
FROM (SELECT *, CASE WHEN started_at IS NULL THEN -1.0 ELSE greatest(0.0, (epoch(TIMESTAMP '2001-08-01') - epoch(started_at)) / 3600.0) END AS h FROM v_running0) WHERE tier IS NOT NULL OR (service_type = 'Cluster' AND h >= 4)"""
oracle("warehouse_event_session", "SELECT * FROM v_event_session")
oracle("running_anomalies", "SELECT * FROM v_running")

# ---- alerts ----
DERIVED["spend_days"] = f"SELECT usage_date, {COST}, {UNITS}, COUNT(DISTINCT workspace_id) AS active_workspaces FROM v_priced WHERE {within(37)} GROUP BY 1"
DERIVED["wow"] = f"SELECT sku_name, billing_origin_product, {r(f'COALESCE(SUM(cost) FILTER (usage_date >= {day(7)}), 0)', 2)} AS cost_7d, {r(f'COALESCE(SUM(cost) FILTER (usage_date < {day(7)}), 0)', 2)} AS cost_prior_7d FROM v_priced WHERE {within(14)} GROUP BY 1, 2"
DERIVED["base"] = """WITH k AS (SELECT *, row_number() OVER (ORDER BY usage_date DESC) AS rn, COUNT(*) OVER () AS n FROM v_spend_days)
SELECT *, COALESCE(AVG(cost) FILTER (rn > 7 OR n <= 7) OVER (), 0) AS base, AVG(cost) FILTER (rn <= 7) OVER () AS recent FROM k"""


def txt(x: str, n: int) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(28,10)), {n}) AS VARCHAR)"


PCT = "(recent - base) * 100 / base"
A1 = f"SELECT 'SPEND_SPIKE' AS type, CASE WHEN {PCT} > 40 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, 'all' AS subject, {r('recent', 2)} AS value, {r('base', 2)} AS baseline, {r(PCT, 1)} AS pct_change FROM v_base WHERE rn = 1 AND base > 0 AND {PCT} > 20"
A2 = f"SELECT 'DAILY_SPIKE' AS type, 'HIGH' AS severity, strftime(usage_date, '%Y-%m-%d') AS subject, {r('cost', 2)} AS value, {r('base', 2)} AS baseline, CAST(NULL AS DOUBLE) AS pct_change FROM v_base WHERE rn <= 7 AND base > 0 AND cost > base * 2"
A3 = f"SELECT 'NEW_SKU' AS type, 'MEDIUM' AS severity, sku_name AS subject, {r('cost_7d', 2)} AS value, CAST(NULL AS DOUBLE) AS baseline, CAST(NULL AS DOUBLE) AS pct_change FROM v_wow WHERE cost_prior_7d = 0 AND cost_7d > 10"
GROW = "(cost_7d - cost_prior_7d) * 100 / cost_prior_7d"
A4 = f"SELECT 'SKU_GROWTH' AS type, 'MEDIUM' AS severity, sku_name AS subject, {r('cost_7d', 2)} AS value, {r('cost_prior_7d', 2)} AS baseline, {r(GROW, 1)} AS pct_change FROM v_wow WHERE cost_prior_7d > 0 AND cost_7d > 0 AND {GROW} > 30"
DERIVED["alerts"] = f"{A1} UNION ALL {A2} UNION ALL {A3} UNION ALL {A4}"
oracle("alert_daily_spend", "SELECT * FROM v_spend_days")
oracle("sku_wow", "SELECT * FROM v_wow")
oracle("alert_spend_spike", A1)
oracle("alert_daily_spike", A2)
oracle("alert_new_sku", A3)
oracle("alert_sku_growth", A4)
oracle("alert_report", "SELECT * FROM v_alerts")
oracle("alert_summary", f"""SELECT {r('SUM(cost) FILTER (rn <= 30)', 2)} AS total_30d, {r('MAX(base)', 2)} AS baseline_avg_daily, {r('MAX(recent)', 2)} AS recent_avg_daily, MAX(usage_date) AS latest_date, max_by(cost, usage_date) AS latest_cost,
  {change('MAX(recent)', 'MAX(base)')} AS pct_vs_baseline, CAST(20.0 AS DOUBLE) AS threshold_pct, (SELECT COUNT(*) FROM v_alerts) AS alert_count FROM v_base""")

# ---- history, baselines, drift ----
RTYPE = "CASE WHEN contains(sku_name, 'ALL_PURPOSE') THEN 'cluster' WHEN contains(sku_name, 'SQL') THEN 'warehouse' WHEN contains(sku_name, 'JOBS') THEN 'job' WHEN contains(sku_name, 'DLT') THEN 'pipeline' ELSE 'other' END"
DERIVED["history"] = f"""SELECT resource_id, {RTYPE} AS resource_type, usage_date, workspace_id, {r('SUM(usage_quantity)', 4)} AS units, {r('SUM(cost)', 4)} AS cost, {r('(epoch(MAX(usage_end_time)) - epoch(MIN(usage_start_time))) / 3600.0', 3)} AS duration_hours,
  CAST(MIN(hour(usage_start_time)) AS INTEGER) AS start_hour, CAST(MIN(dayofweek(usage_start_time) + 1) AS INTEGER) AS weekday FROM v_priced WHERE {within(90)} AND resource_id IS NOT NULL GROUP BY 1, 2, 3, 4"""
DERIVED["profile"] = """SELECT resource_id, COUNT(*) AS session_count, MIN(resource_type) AS resource_type, """ + ", ".join(
    f"quantile_cont({c}, 0.5) AS p50_{c}, greatest(stddev_pop({c}), 0.001) AS std_{c}" for c in ("units", "cost", "duration_hours")
) + " FROM v_history GROUP BY 1 HAVING COUNT(*) >= 5"
oracle("resource_history", "SELECT * FROM v_history")
oracle("baseline_profile", "SELECT resource_id, session_count, resource_type, " + ", ".join(f"{r(f'{p}_{c}', 6)} AS {p}_{c}" for c in ("units", "cost", "duration_hours") for p in ("p50", "std")) + " FROM v_profile")
oracle("baseline_zscore", f"""
WITH z AS (SELECT x.resource_id, x.name, greatest((x.duration_hours - p50_duration_hours) / std_duration_hours, 0.0) AS zd, greatest((COALESCE(x.cost, 0) - p50_cost) / std_cost, 0.0) AS zc, greatest((COALESCE(x.units, 0) - p50_units) / std_units, 0.0) AS zu FROM v_running x JOIN v_profile p USING (resource_id))
SELECT resource_id, name, {r('zd', 2)} AS z_duration, {r('zc', 2)} AS z_cost, {r('zu', 2)} AS z_units, {r('greatest(zd, zc, zu)', 2)} AS max_z_score, {r('least(greatest(zd, zc, zu) / 5, 1.0)', 3)} AS score FROM z WHERE greatest(zd, zc, zu) >= 2""")
TAU = "6.283185307179586"
oracle("anomaly_features", f"""
SELECT resource_id, resource_type, usage_date, workspace_id, {r('ln(1 + units / greatest(duration_hours, 0.01))', 6)} AS f_rate, {r('ln(1 + cost)', 6)} AS f_cost, {r('ln(1 + greatest(duration_hours, 0.01))', 6)} AS f_hours,
  {r(f'sin({TAU} * start_hour / 24)', 6)} AS f_hour_sin, {r(f'cos({TAU} * start_hour / 24)', 6)} AS f_hour_cos, {r(f'sin({TAU} * weekday / 7)', 6)} AS f_dow_sin, {r(f'cos({TAU} * weekday / 7)', 6)} AS f_dow_cos,
  CAST(CASE resource_type WHEN 'cluster' THEN 0 WHEN 'warehouse' THEN 1 WHEN 'job' THEN 2 WHEN 'pipeline' THEN 3 ELSE 4 END AS DOUBLE) AS f_type FROM v_history""")
PROD = "CASE WHEN contains(sku_name, 'ALL_PURPOSE') THEN 'All Purpose Compute' WHEN contains(sku_name, 'SQL') THEN 'SQL Warehouse' WHEN contains(sku_name, 'JOBS') THEN 'Jobs Compute' WHEN contains(sku_name, 'DLT') THEN 'Delta Live Tables' ELSE 'Other' END"
DERIVED["day_cost"] = f"""SELECT workspace_id, usage_date, {PROD} AS product, resource_id, COALESCE(tag_product_name, tag_product) AS product_tag, tag_env AS env_tag, CAST(NULL AS VARCHAR) AS subscription_tag, CAST(NULL AS VARCHAR) AS resource_group_tag,
  {r('SUM(cost)', 4)} AS cost, {r('SUM(usage_quantity)', 4)} AS units FROM v_priced WHERE {within(30)} GROUP BY 1, 2, 3, 4, 5, 6"""
oracle("daily_cost_by_resource", "SELECT * FROM v_day_cost")


def drift(source: str, keys: str) -> str:
    return f"""
WITH k AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY usage_date DESC) AS rn FROM ({source})),
s AS (SELECT {keys}, COUNT(*) AS n, AVG(cost) FILTER (rn <= 7) AS recent, AVG(cost) FILTER (rn > 7) AS prior, MAX(cost) FILTER (rn = 1 AND usage_date = {day()}) AS today FROM k WHERE rn <= 14 GROUP BY {keys} HAVING COUNT(*) >= 7),
t AS (SELECT *, CASE WHEN today > 0 AND recent > 0.01 AND today > recent * 2 THEN 'cost_spike' WHEN prior > 0.01 AND recent > prior * 1.3 THEN 'cost_trend' END AS alert_type FROM s),
u AS (SELECT *, CASE WHEN alert_type = 'cost_spike' THEN {r('(today - recent) * 100 / recent', 1)} ELSE {r('(recent - prior) * 100 / prior', 1)} END AS pct_change FROM t WHERE alert_type IS NOT NULL)
SELECT {keys}, alert_type, {r('today', 2)} AS today_cost, {r('recent', 2)} AS recent_avg, {r('prior', 2)} AS prior_avg, pct_change, CASE WHEN alert_type = 'cost_spike' AND pct_change > 100 THEN 'critical' ELSE 'warning' END AS severity FROM u"""


DERIVED["drifts"] = drift("SELECT * FROM v_day_cost", "workspace_id, product, resource_id, product_tag, env_tag, subscription_tag, resource_group_tag")
DERIVED["ws_drifts"] = drift("SELECT workspace_id, usage_date, SUM(cost) AS cost FROM v_day_cost GROUP BY 1, 2", "workspace_id")
oracle("drift_alerts", "SELECT * FROM v_drifts")
oracle("join_alert_context", "SELECT d.*, w.workspace_name, w.subscription_id AS subscription, w.resource_group FROM v_ws_drifts d LEFT JOIN v_workspaces w USING (workspace_id)")
DERIVED["billed_to"] = f"SELECT resource_id, MAX(usage_end_time) AS last_billing_end FROM v_priced WHERE {within(2)} AND resource_id IS NOT NULL GROUP BY 1"
DERIVED["idle"] = f"""SELECT resource_id, service_type, name, workspace_name, environment, started_at, duration_hours, last_billing_end, {r('h', 1)} AS idle_hours, CASE WHEN h >= 4 THEN 'critical' ELSE 'warning' END AS severity
FROM (SELECT x.*, b.last_billing_end, COALESCE((epoch(TIMESTAMP '2001-08-01') - epoch(b.last_billing_end)) / 3600.0, x.duration_hours) AS h FROM v_running x LEFT JOIN v_billed_to b USING (resource_id)) WHERE h >= 1.5"""
oracle("last_billing", "SELECT * FROM v_billed_to")
oracle("idle_resources", "SELECT * FROM v_idle")
oracle("anomaly_summary", """SELECT COUNT(*) AS training_records, 90 AS training_window_days, COUNT(*) >= 30 AS forest_trained, (SELECT COUNT(*) FROM v_profile) AS resources_with_baseline, (SELECT COUNT(*) FROM v_running) AS running_resources,
  (SELECT COUNT(*) FROM v_drifts) AS drift_alerts, (SELECT COUNT(*) FROM v_idle) AS idle_resources FROM v_history""")

# ---- API clients ----
DERIVED["requests"] = f"""SELECT *, CASE WHEN broken THEN 'unreadable_headers' WHEN agent = '' THEN 'missing_user_agent' WHEN contains(agent, 'curl/') THEN 'bot_user_agent' WHEN tier <> 'static' AND accept = '' THEN 'missing_accept_header' END AS reason
FROM (SELECT client, CASE service_name WHEN 'accounts' THEN 'auth' WHEN 'iamService' THEN 'heavy' WHEN 'dashboards' THEN 'static' ELSE 'api' END AS tier, event_time, epoch_us(event_time) AS us, request_id, status_code, headers NOT LIKE '%}}' AS broken,
  regexp_extract(headers, '"user-agent": "([^"]*)"', 1) AS agent, regexp_extract(headers, '"accept": "([^"]*)"', 1) AS accept FROM v_request_log WHERE {ets_within(30, 'event_time')})"""
LIM60, LIM5 = "CASE tier WHEN 'auth' THEN 20 WHEN 'heavy' THEN 30 WHEN 'api' THEN 120 ELSE 200 END", "CASE tier WHEN 'auth' THEN 5 WHEN 'heavy' THEN 5 WHEN 'api' THEN 20 ELSE 40 END"


def busiest(seconds: int, limit: str) -> str:
    return f"""SELECT client, tier, CAST(MAX(t) AS BIGINT) AS peak_{seconds}s, COUNT(*) FILTER (t > {limit}) AS violations_{seconds}s FROM (
  SELECT *, SUM(n) OVER (PARTITION BY client, tier ORDER BY s RANGE BETWEEN {seconds - 1} PRECEDING AND CURRENT ROW) AS t FROM (
    SELECT client, tier, us // 1000000 AS s, COUNT(*) AS n FROM v_requests GROUP BY 1, 2, 3)) GROUP BY 1, 2"""


oracle("request_rate_violations", f"SELECT * FROM ({busiest(60, LIM60)}) JOIN ({busiest(5, LIM5)}) USING (client, tier)")


# The limiter row by row, all clients at once: each step of the recursion takes every client's next request.
KEEP = "list_filter({x}, lambda e: q.us - e{us} < {seconds} * 1000000)"
oracle("failure_ban_candidates", f"""
WITH RECURSIVE q AS (SELECT client, tier, us, {LIM60} AS lim, {LIM5} AS burst, status_code = 403 AS denied, reason IS NOT NULL AND tier <> 'static' AS blocked, row_number() OVER (PARTITION BY client ORDER BY us, request_id) AS rn FROM v_requests),
s AS (
  SELECT client, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS until, CAST([] AS STRUCT(tier VARCHAR, us BIGINT)[]) AS b, CAST([] AS STRUCT(tier VARCHAR, us BIGINT)[]) AS m, CAST([] AS BIGINT[]) AS v, CAST([] AS BIGINT[]) AS f,
    CAST('' AS VARCHAR) AS outcome, CAST(NULL AS BIGINT) AS ban, CAST(0 AS BIGINT) AS nv, CAST(0 AS BIGINT) AS nf FROM (SELECT DISTINCT client FROM q)
  UNION ALL
  SELECT client, rn, CASE WHEN nv >= 5 OR nf >= 10 THEN us + 300000000 ELSE until END, b, m, CASE WHEN nv >= 5 THEN [] ELSE v END, CASE WHEN nf >= 10 THEN [] ELSE f END,
    outcome, CASE WHEN nv >= 5 OR nf >= 10 THEN us END, nv, nf
  FROM (
    SELECT client, rn, us, until, outcome, CASE WHEN outcome IN ('rate', 'denied', 'accepted') THEN list_append(b, {{'tier': tier, 'us': us}}) ELSE b END AS b, CASE WHEN outcome IN ('denied', 'accepted') THEN list_append(m, {{'tier': tier, 'us': us}}) ELSE m END AS m,
      CASE WHEN outcome IN ('blocked', 'burst', 'rate') THEN list_append(v, us) ELSE v END AS v, CASE WHEN outcome = 'denied' THEN list_append(f, us) ELSE f END AS f,
      CASE WHEN outcome IN ('blocked', 'burst', 'rate') THEN len(v) + 1 ELSE 0 END AS nv, CASE WHEN outcome = 'denied' THEN len(f) + 1 ELSE 0 END AS nf
    FROM (
      SELECT *, CASE WHEN us < until THEN 'banned' WHEN blocked THEN 'blocked' WHEN len(list_filter(b, lambda e: e.tier = tier)) >= burst THEN 'burst' WHEN len(list_filter(m, lambda e: e.tier = tier)) >= lim THEN 'rate' WHEN denied THEN 'denied' ELSE 'accepted' END AS outcome
      FROM (SELECT q.*, s.until, {KEEP.format(x='s.b', us='.us', seconds=5)} AS b, {KEEP.format(x='s.m', us='.us', seconds=60)} AS m, {KEEP.format(x='s.v', us='', seconds=300)} AS v, {KEEP.format(x='s.f', us='', seconds=600)} AS f
        FROM s JOIN q ON q.client = s.client AND q.rn = s.rn + 1)))
)
SELECT client, {', '.join(f"COUNT(*) FILTER (outcome = '{o}') AS {o}" for o in ('accepted', 'denied', 'blocked', 'burst', 'rate', 'banned'))}, COUNT(ban) AS bans, make_timestamp(MIN(ban)) AS first_ban, make_timestamp(MAX(ban)) AS last_ban,
  MAX(nf) AS peak_failures, MAX(nv) AS peak_violations, COUNT(ban) > 0 AS is_candidate FROM s WHERE rn > 0 GROUP BY client""")
oracle("suspicious_agents", "SELECT client, reason, COUNT(*) AS request_count FROM v_requests WHERE reason IS NOT NULL GROUP BY 1, 2")

# The forest is random, but what its trees are grown from, and how scores and flags agree, is not.
oracle("iforest_trees", """
SELECT CAST(t AS INTEGER) AS tree, least(256, n) AS sampled_rows, least(256, n) AS leaf_rows, TRUE AS depth_in_limit FROM range(100) x(t), (SELECT COUNT(*) AS n FROM v_history) WHERE n >= 30""")
oracle("iforest_checks", "SELECT resource_id, service_type, name, TRUE AS score_in_range, TRUE AS flag_follows FROM v_running")
# A sketch of less than four hundred values holds them all.
oracle("baseline_sketched", "SELECT resource_id, COUNT(*) AS session_count, quantile_disc(units, 0.5) AS median_units, quantile_disc(cost, 0.5) AS median_cost, quantile_disc(duration_hours, 0.5) AS median_duration_hours FROM v_history GROUP BY 1 HAVING COUNT(*) >= 5")
