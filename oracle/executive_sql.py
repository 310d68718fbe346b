from oracle.sql import COST, MINUTES, UNITS, change, day, eday, oracle, pct, r, ts_within, within

W30, W7 = within(30), within(7)
DAILY = f"d AS (SELECT usage_date, {COST}, {UNITS} FROM v_priced WHERE {W30} GROUP BY 1)"

oracle("spend_scorecard", f"""
WITH s AS (SELECT {r(f"COALESCE(SUM(CASE WHEN usage_date >= {day(30)} THEN cost END), 0)", 2)} AS cost_30d, {r(f"COALESCE(SUM(CASE WHEN usage_date < {day(30)} THEN cost END), 0)", 2)} AS cost_prev_30d,
  {r(f"CAST(COALESCE(SUM(CASE WHEN usage_date >= {day(14)} THEN cost END), 0) AS DOUBLE) / 14", 4)} AS avg_daily_14d, {r("COALESCE(SUM(CASE WHEN usage_date >= DATE '2001-08-01' THEN cost END), 0)", 2)} AS month_to_date,
  {r(f"COALESCE(SUM(CASE WHEN usage_date >= {day(30)} THEN usage_quantity END), 0)", 2)} AS units_30d, COUNT(DISTINCT CASE WHEN usage_date >= {day(30)} THEN workspace_id END) AS workspace_count
  FROM v_priced WHERE {within(60)})
SELECT *, {change('cost_30d', 'cost_prev_30d')} AS mom_delta_pct FROM s""")
oracle("month_end_projection", f"""
WITH {DAILY}, f AS (SELECT COUNT(*) AS days_of_data, {r("COALESCE(SUM(CASE WHEN usage_date >= DATE '2001-08-01' THEN cost END), 0)", 2)} AS month_to_date,
  COALESCE(SUM(CASE WHEN usage_date >= {day(14)} THEN cost END), 0) / 14 AS a, regr_slope(cost, usage_date - {day(30)}) AS b, regr_intercept(cost, usage_date - {day(30)}) AS c FROM d),
g AS (SELECT SUM(greatest(0.0, c + b * (30 + i))) AS t FROM f, range(1, 31) x(i)),
h AS (SELECT *, CASE WHEN days_of_data >= 7 THEN t ELSE a * 30 END AS rest FROM f, g)
SELECT days_of_data, month_to_date, 30 AS days_remaining, {r('rest', 2)} AS forecast_remaining, {r('month_to_date + rest', 2)} AS projected_month_end,
  CASE WHEN days_of_data >= 7 THEN 'trend' ELSE 'average' END AS method FROM h""")
oracle("run_rate", f"""
WITH {DAILY}, s AS (SELECT {r('SUM(cost)', 2)} AS total_usage, {r(f"SUM(CASE WHEN usage_date >= {day(14)} THEN cost ELSE 0 END)", 2)} AS t14, COUNT(*) AS n30, SUM(CASE WHEN usage_date >= {day(14)} THEN 1 ELSE 0 END) AS n14,
  MIN(usage_date) AS period_start, MAX(usage_date) AS period_end FROM d),
a AS (SELECT *, {r('total_usage / n30', 2)} AS run_rate_per_day FROM s),
b AS (SELECT *, {r('t14 / n14 * 0.6 + (CASE WHEN n30 > n14 THEN (total_usage - t14) / (n30 - n14) ELSE run_rate_per_day END) * 0.4', 2)} AS forecasted_run_rate FROM a)
SELECT total_usage, period_start, period_end, run_rate_per_day, forecasted_run_rate, {change('forecasted_run_rate', 'run_rate_per_day')} AS forecast_pct_change, {r('forecasted_run_rate * 30', 2)} AS forecasted_usage,
  {day(-1)} AS forecast_start, {day(-30)} AS forecast_end FROM b""")
oracle("exec_cost_trend", f"WITH {DAILY} SELECT * FROM d")
WST = f"w AS (SELECT u.workspace_id, u.cost, u.units, COALESCE(n.workspace_name, u.workspace_id) AS workspace_name FROM (SELECT workspace_id, {COST}, {UNITS} FROM v_priced WHERE {W30} GROUP BY 1) u LEFT JOIN v_workspaces n USING (workspace_id))"
oracle("top_workspaces", f"WITH {WST} SELECT * FROM w ORDER BY cost DESC, workspace_id LIMIT 8")
oracle("join_workspace_dim", f"WITH {WST} SELECT * FROM w")
oracle("top_products", f"""
SELECT CASE billing_origin_product WHEN 'JOBS' THEN 'Jobs Compute' WHEN 'SQL' THEN 'SQL Warehouses' WHEN 'DLT' THEN 'Delta Live Tables' WHEN 'ALL_PURPOSE' THEN 'Interactive Clusters' ELSE 'Model Serving' END AS product_category,
  {COST}, {UNITS} FROM v_priced WHERE {W30} GROUP BY billing_origin_product""")
oracle("forecast_7d", f"""
WITH {DAILY}, k AS (SELECT *, row_number() OVER (ORDER BY usage_date DESC) AS rn FROM d),
f AS (SELECT AVG(cost) FILTER (rn <= 7) AS m7, AVG(cost) AS m30, regr_slope(cost, 7 - rn) FILTER (rn <= 7) AS b, max_by(cost, usage_date) AS last_actual_cost, COUNT(*) AS n FROM k),
v AS (SELECT i, {r('greatest(0.0, m7 + b * i)', 2)} AS cost, m30, last_actual_cost FROM f, range(1, 8) x(i) WHERE n >= 7),
a AS (SELECT AVG(cost) AS af FROM v)
SELECT CAST({day()} + CAST(i AS INTEGER) AS DATE) AS forecast_date, cost, {r('af', 2)} AS avg_forecast_daily, {change('af', 'm30')} AS forecast_pct_change, last_actual_cost FROM v, a""")
oracle("pareto_top", f"WITH {WST} SELECT workspace_id, workspace_name, cost, CAST(row_number() OVER (ORDER BY cost DESC, workspace_id) AS INTEGER) AS rank FROM w QUALIFY rank <= 10")
oracle("pareto", f"""
WITH {WST}, k AS (SELECT *, row_number() OVER (ORDER BY cost DESC, workspace_id) AS rank FROM w),
s AS (SELECT SUM(cost) FILTER (rank <= 5) AS c5, SUM(cost) FILTER (rank <= 10) AS c10, SUM(cost) AS t FROM k)
SELECT {pct('c5', 't')} AS top_5_pct, {pct('c10', 't')} AS top_10_pct, {r(f"100.0 - {pct('c10', 't')}", 1)} AS long_tail_pct, {r('t', 2)} AS total_cost FROM s""")
RUNS = f"""j AS (SELECT 'job' AS kind, r.run_id, r.period_start_time, r.period_end_time, r.result_state = 'SUCCEEDED' AS succeeded, r.result_state IN ('FAILED', 'CANCELLED', 'TIMED_OUT', 'ERROR') AS failed
  FROM v_job_runs r JOIN v_jobs_latest l USING (workspace_id, job_id) JOIN v_workspaces w USING (workspace_id)
  WHERE {ts_within(30, 'r.period_start_time')} AND r.result_state IS NOT NULL AND lower(w.workspace_name) LIKE '%prod%'
  UNION ALL SELECT 'pipeline', r.update_id, r.period_start_time, r.period_end_time, r.result_state = 'COMPLETED', r.result_state IN ('FAILED', 'CANCELED')
  FROM v_pipeline_updates r JOIN v_pipelines_latest l USING (workspace_id, pipeline_id) JOIN v_workspaces w USING (workspace_id)
  WHERE {ts_within(30, 'r.period_start_time')} AND r.result_state IS NOT NULL AND lower(w.workspace_name) LIKE '%prod%')"""
oracle("job_health", f"""
WITH {RUNS}, k AS (SELECT kind, COUNT(DISTINCT run_id) AS runs, COUNT(*) FILTER (succeeded) AS ok, COUNT(*) FILTER (failed) AS bad, {r(f'AVG({MINUTES}) FILTER (succeeded)', 1)} AS mean, SUM({MINUTES}) FILTER (succeeded) AS mins FROM j GROUP BY 1),
s AS (SELECT CAST(COALESCE(SUM(runs) FILTER (kind = 'job'), 0) AS BIGINT) AS job_runs_30d, CAST(COALESCE(SUM(runs) FILTER (kind = 'pipeline'), 0) AS BIGINT) AS pipeline_runs_30d, CAST(SUM(runs) AS BIGINT) AS total_runs_30d,
  CAST(SUM(ok) AS BIGINT) AS succeeded_30d, CAST(SUM(bad) AS BIGINT) AS failed_30d, {r("(COALESCE(SUM(mean) FILTER (kind = 'job'), 0) + COALESCE(SUM(mean) FILTER (kind = 'pipeline'), 0)) / 2", 1)} AS avg_duration_mins, SUM(mins) AS mins FROM k)
SELECT s.* EXCLUDE (mins), {pct('succeeded_30d', 'total_runs_30d')} AS success_rate_pct, {r('mins / succeeded_30d', 1)} AS weighted_duration_mins FROM s""")
oracle("join_using_latest", f"WITH {RUNS} SELECT kind, succeeded, failed, COUNT(*) AS row_count FROM j GROUP BY 1, 2, 3")
oracle("active_users", f"""
SELECT COUNT(DISTINCT user_email) AS active_users_30d, COUNT(DISTINCT CASE WHEN event_date >= {eday(7)} THEN user_email END) AS active_users_7d, COUNT(DISTINCT service_name) AS services_used_30d
FROM v_audit WHERE event_date BETWEEN {eday(30)} AND {eday()} AND user_email IS NOT NULL AND trim(user_email) <> ''""")
S1 = f"""s1 AS (SELECT COUNT(*) AS n, {r('SUM(cost)', 2)} AS b FROM (SELECT cluster_id, {COST} FROM v_priced WHERE {W7} AND contains(sku_name, 'ALL_PURPOSE') AND cluster_id IS NOT NULL AND job_run_id IS NULL GROUP BY 1 HAVING {r('SUM(cost)', 2)} > 20)),
o1 AS (SELECT 'Interactive compute waste' AS category, n AS resource_count, b AS basis, {r('b * 0.4', 2)} AS estimated_saving, CASE WHEN {r('b * 0.4', 2)} > 500 THEN 'critical' ELSE 'warning' END AS priority FROM s1 WHERE n > 0)"""
S2 = f"""s2 AS (SELECT COUNT(*) AS n, {r('SUM(cost)', 2)} AS b FROM (SELECT warehouse_id, {COST}, COUNT(DISTINCT usage_date) AS k FROM v_priced WHERE {W30} AND contains(sku_name, 'SQL') AND warehouse_id IS NOT NULL GROUP BY 1 HAVING COUNT(DISTINCT usage_date) >= 5 AND {r('SUM(cost)', 2)} > 50)),
o2 AS (SELECT 'SQL Warehouse right-sizing' AS category, n AS resource_count, b AS basis, {r('b * 0.25', 2)} AS estimated_saving, 'warning' AS priority FROM s2 WHERE n > 0)"""
S3 = f"""s3 AS (SELECT COUNT(*) AS n, {r('SUM((epoch(period_end_time) - epoch(period_start_time)) / 3600.0)', 1)} AS b FROM v_job_runs WHERE {ts_within(7, 'period_start_time')} AND result_state IN ('FAILED', 'TIMED_OUT') AND epoch(period_end_time) - epoch(period_start_time) > 3600),
o3 AS (SELECT 'Failed long-running jobs' AS category, n AS resource_count, b AS basis, 0.0 AS estimated_saving, 'info' AS priority FROM s3 WHERE n > 0)"""
S4 = f"""s4 AS (SELECT COUNT(DISTINCT COALESCE(warehouse_id, cluster_id, sku_name)) AS n, {r('SUM(cost)', 2)} AS b FROM v_priced WHERE {W7} AND sku_name LIKE 'PREMIUM_%COMPUTE%'),
o4 AS (SELECT 'Anomalous compute spend' AS category, n AS resource_count, b AS basis, {r('b * 0.3', 2)} AS estimated_saving, 'warning' AS priority FROM s4 WHERE n > 0 AND b > 0)"""
oracle("savings_interactive", f"WITH {S1} SELECT * FROM o1")
oracle("savings_warehouse", f"WITH {S2} SELECT * FROM o2")
oracle("savings_failed_jobs", f"WITH {S3} SELECT category, resource_count, basis, CAST(estimated_saving AS DOUBLE) AS estimated_saving, priority FROM o3")
oracle("savings_compute", f"WITH {S4} SELECT * FROM o4")
oracle("savings_opportunities", f"""
WITH {S1}, {S2}, {S3}, {S4}, u AS (SELECT * FROM o1 UNION ALL SELECT * FROM o2 UNION ALL SELECT category, resource_count, basis, CAST(estimated_saving AS DOUBLE), priority FROM o3 UNION ALL SELECT * FROM o4)
SELECT *, {r('SUM(estimated_saving) OVER ()', 2)} AS total_saving FROM u""")
oracle("annual_forecast", f"""
WITH m AS (SELECT CAST(date_trunc('month', usage_date) AS DATE) AS month, {COST} FROM v_priced WHERE usage_date >= DATE '1999-08-01' AND usage_date < {day()} GROUP BY 1),
x AS (SELECT *, date_diff('month', DATE '1999-08-01', month) AS x, month < DATE '2001-08-01' AS f FROM m),
l AS (SELECT regr_slope(cost, x) FILTER (f) AS b, regr_intercept(cost, x) FILTER (f) AS a FROM x),
n AS (SELECT month(month) AS mo, AVG(cost / (a + b * x)) FILTER (f) AS season FROM x, l GROUP BY 1),
t AS (SELECT {r('SUM((a + b * ((mo - 8 + 12) % 12 + 36)) * season)', 2)} AS trend FROM n, l),
s AS (SELECT {r("COALESCE(SUM(cost) FILTER (month >= DATE '1999-08-01' AND month < DATE '2000-08-01'), 0)", 2)} AS cy1_cost, {r("COALESCE(SUM(cost) FILTER (month >= DATE '2000-08-01' AND month < DATE '2001-08-01'), 0)", 2)} AS cy2_cost,
  0.0 AS cy_current_cost, COUNT(*) AS data_months FROM x),
g AS (SELECT *, CASE WHEN cy1_cost > 0 AND cy2_cost > 0 THEN greatest(-0.5, least(2.0, (cy2_cost - cy1_cost) / cy1_cost)) END AS growth FROM s, t)
SELECT 'Aug 1999 - Jul 2000' AS cy1_label, cy1_cost, 'Aug 2000 - Jul 2001' AS cy2_label, cy2_cost, 'Aug 2001 - Jul 2002' AS cy_current_label, CAST(cy_current_cost AS DOUBLE) AS cy_current_cost, 0 AS cy_current_months,
  'Aug 2002 - Jul 2003' AS forecast_label, CASE WHEN trend > 0 THEN trend ELSE {r('cy2_cost * (1 + COALESCE(growth, 0))', 2)} END AS forecast_cost, CASE WHEN trend > 0 THEN 'trend' ELSE 'yoy' END AS forecast_method,
  {r('cy2_cost * (1 + COALESCE(growth, 0))', 2)} AS yoy_forecast_cost, {r('growth * 100', 1)} AS yoy_growth_pct, data_months FROM g""")
AREA = "COALESCE(tag_product_name, tag_product, 'Untagged') AS product_area"
oracle("product_area_spend", f"SELECT {AREA}, {COST}, {UNITS} FROM v_priced WHERE {W30} GROUP BY 1")
oracle("chargeback", f"SELECT {AREA}, COALESCE(w.workspace_name, workspace_id) AS workspace_name, {COST}, {UNITS} FROM v_priced LEFT JOIN v_workspaces w USING (workspace_id) WHERE {W30} GROUP BY 1, 2")
oracle("infra_costs", f"""
SELECT CASE billing_origin_product WHEN 'JOBS' THEN 'Jobs' WHEN 'SQL' THEN 'SQL Warehouses' WHEN 'DLT' THEN 'Delta Live Tables' WHEN 'ALL_PURPOSE' THEN 'Interactive Clusters' ELSE 'Model Serving' END AS infra_category,
  usage_type, COALESCE(w.workspace_name, workspace_id) AS workspace_name, {r('SUM(usage_quantity)', 4)} AS units, {r('SUM(cost)', 4)} AS cost
FROM v_priced LEFT JOIN v_workspaces w USING (workspace_id) WHERE {W30} AND usage_type IN ('STORAGE_SPACE', 'NETWORK_BYTE') GROUP BY 1, 2, 3""")
oracle("sla_breaches", f"""
WITH l AS (SELECT * FROM v_jobs_ranked WHERE rn = 1 AND lower(tag_env) IN ('prod', 'production', 'prd'))
SELECT r.run_id, l.name AS job_name, r.workspace_id, r.result_state, r.termination_code, r.period_start_time AS started_at, r.period_end_time AS ended_at, {r(MINUTES, 1)} AS duration_mins
FROM v_job_runs r JOIN l USING (workspace_id, job_id) WHERE {ts_within(7, 'r.period_start_time')} AND r.result_state IN ('FAILED', 'TIMED_OUT', 'ERROR', 'CANCELLED') ORDER BY started_at DESC, run_id LIMIT 50""")
oracle("governance_signals", f"""
SELECT COUNT(*) FILTER (action_name = 'createToken') AS new_tokens_7d, COUNT(*) FILTER (action_name IN ('deleteToken', 'revokeToken')) AS revoked_tokens_7d, COUNT(*) FILTER (action_name IN ('addGroupMember', 'removeGroupMember')) AS group_changes_7d,
  COUNT(*) FILTER (contains(action_name, 'Permission') OR contains(action_name, 'Grant')) AS permission_changes_7d, COUNT(DISTINCT user_email) AS distinct_actors_7d FROM v_audit WHERE event_date BETWEEN {eday(7)} AND {eday()}""")


# ---- exponential smoothing, period by period ----
def smoothed(values: str, m: int, first: int, last: int) -> str:
    """CTEs up to ``fc``: series, periods, forecast, low, high. ``values`` gives series, p, v without gaps at the end."""
    grid = ", ".join(f"({a}, {b}, {g})" for a in (0.1, 0.3, 0.5, 0.7, 0.9) for b in (0.0, 0.05, 0.2) if b < a for g in (0.0, 0.1, 0.3))
    mid = (m - 1) / 2
    return f"""
g AS (SELECT row_number() OVER () AS nr, CAST(a AS DOUBLE) AS a, CAST(be AS DOUBLE) AS be, CAST(ga AS DOUBLE) AS ga FROM (VALUES {grid}) x(a, be, ga)),
vals AS ({values}),
lims AS (SELECT series, MIN(p) AS p0, MAX(p) AS p1 FROM vals GROUP BY 1),
filled AS (SELECT series, t, SUM(v) AS v FROM (SELECT series, p - p0 AS t, v FROM vals JOIN lims USING (series) UNION ALL SELECT series, unnest(range(0, p1 - p0 + 1)), 0 FROM lims) GROUP BY 1, 2),
y AS (SELECT series, list(v ORDER BY t) AS y, COUNT(*) AS n FROM filled GROUP BY 1),
i AS (SELECT *, list_avg(y[1:{m}]) AS m1, (list_avg(y[{m + 1}:{2 * m}]) - list_avg(y[1:{m}])) / {m} AS b0 FROM y WHERE n >= {2 * m + 1}),
r AS (
  SELECT series, nr, a, be, ga, {m} AS t, m1 + b0 * {mid} AS l, b0 AS b, list_transform(range(0, {m}), lambda k: y[k + 1] - (m1 + b0 * (k - {mid}))) AS s, CAST(0 AS DOUBLE) AS sse FROM i, g
  UNION ALL
  SELECT series, nr, a, be, ga, t + 1, l + b + a * e, b + be * e, list_transform(range(0, {m}), lambda k: CASE WHEN k = t % {m} THEN s[k + 1] + ga * e ELSE s[k + 1] END), sse + e * e
  FROM (SELECT r.*, i.y[t + 1] - (l + b + s[t % {m} + 1]) AS e FROM r JOIN i USING (series) WHERE t < n)
),
best AS (SELECT r.*, n FROM r JOIN i USING (series) WHERE t = n QUALIFY row_number() OVER (PARTITION BY series ORDER BY sse, nr) = 1),
parts AS (
  SELECT series, list_sum(list_transform(range({first}, {last + 1}), lambda h: greatest(0, l + h * b + s[(n + h - 1) % {m} + 1]))) AS mean,
    sqrt(sse / (n - {m}) * list_sum(list_transform(range(1, {last + 1}), lambda j: pow(list_sum(list_transform(range(greatest({first}, j), {last + 1}), lambda h: CASE WHEN h = j THEN 1 ELSE a + be * (h - j) + CASE WHEN (h - j) % {m} = 0 THEN ga ELSE 0 END END)), 2)))) AS dev
  FROM best
),
fc AS (SELECT y.series, n AS periods, mean AS forecast, greatest(0, mean - 1.96 * dev) AS low, mean + 1.96 * dev AS high FROM y LEFT JOIN parts USING (series))"""


def by_series(source: str, period: str) -> str:
    return f"""SELECT series, {period} AS p, {r('SUM(cost)', 2)} AS v FROM (SELECT usage_date, cost, unnest(['all', product_category]) AS series FROM ({source})) GROUP BY 1, 2"""


LAST90 = f"SELECT * FROM v_priced WHERE {within(90)}"
DAYS = by_series(LAST90, f"date_diff('day', {day(90)}, usage_date)")
oracle("month_end_smoothed", f"""WITH RECURSIVE {smoothed(f"WITH d AS ({DAYS}) SELECT * FROM d UNION ALL SELECT DISTINCT series, 90, 0 FROM d", 7, 1, 30)},
d AS ({DAYS}),
s AS (SELECT series, {r(f"SUM(v) FILTER (p >= date_diff('day', {day(90)}, DATE '2001-08-01'))", 2)} AS mtd, COALESCE(SUM(v) FILTER (p > 76), 0) / 14 * 30 AS avg FROM d GROUP BY 1)
SELECT series, periods AS days_of_data, COALESCE(mtd, 0) AS month_to_date, 30 AS days_remaining, {r('COALESCE(forecast, avg)', 2)} AS forecast_remaining, {r('COALESCE(mtd, 0) + COALESCE(forecast, avg)', 2)} AS projected_month_end,
  {r('COALESCE(mtd, 0) + low', 2)} AS projected_low, {r('COALESCE(mtd, 0) + high', 2)} AS projected_high, CASE WHEN forecast IS NULL THEN 'average' ELSE 'smoothing' END AS method FROM s JOIN fc USING (series)""")
FULL = "SELECT * FROM v_priced WHERE usage_date >= DATE '1996-08-01' AND usage_date < DATE '2001-08-01'"
MONTHS = by_series(FULL, "date_diff('month', DATE '1996-08-01', date_trunc('month', usage_date))")
oracle("annual_smoothed", f"""WITH RECURSIVE {smoothed(f"WITH d AS ({MONTHS}) SELECT * FROM d UNION ALL SELECT DISTINCT series, 59, 0 FROM d", 12, 13, 24)},
c AS (SELECT series, {r('SUM(v)', 2)} AS cost FROM ({MONTHS}) GROUP BY 1)
SELECT series, periods AS months_of_data, cost AS cost_so_far, DATE '2002-08-01' AS year_start, {r('COALESCE(forecast, cost / periods * 12)', 2)} AS forecast_cost, {r('low', 2)} AS forecast_low, {r('high', 2)} AS forecast_high,
  CASE WHEN forecast IS NULL THEN 'average' ELSE 'smoothing' END AS method FROM c JOIN fc USING (series)""")
