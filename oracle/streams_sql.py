from oracle.sql import COST, day, oracle, r, within

W30 = within(30)
oracle("stream_daily_cost", f"SELECT usage_date, product_category, {r('SUM(usage_quantity)', 4)} AS units, {COST} FROM v_priced WHERE {W30} GROUP BY 1, 2")
oracle("stream_sessions", f"""
WITH u AS (SELECT * FROM v_usage_flat WHERE {W30} AND warehouse_id IS NOT NULL),
p AS (SELECT *, MAX(usage_end_time) OVER (PARTITION BY warehouse_id ORDER BY usage_start_time, usage_end_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM u),
s AS (SELECT *, SUM(CASE WHEN reached IS NULL OR epoch(usage_start_time) - epoch(reached) > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY warehouse_id ORDER BY usage_start_time, usage_end_time ROWS UNBOUNDED PRECEDING) AS n FROM p),
g AS (SELECT warehouse_id, MIN(usage_start_time) AS session_start, MAX(usage_end_time) AS session_end, {r('SUM(usage_quantity)', 3)} AS units, COUNT(*) AS row_count FROM s GROUP BY warehouse_id, n)
SELECT * FROM g WHERE epoch_ms(session_end) + 3600001 <= (SELECT epoch_ms(MAX(usage_start_time)) - 7200000 FROM u)""")
oracle("stream_rate_violations", """
SELECT client, tier, make_timestamp(w * 5000000) AS window_start, COUNT(*) AS n FROM (
  SELECT client, CASE service_name WHEN 'accounts' THEN 'auth' WHEN 'iamService' THEN 'heavy' WHEN 'dashboards' THEN 'static' ELSE 'api' END AS tier, epoch_us(event_time) // 5000000 - k AS w FROM v_request_log, range(0, 12) x(k)) GROUP BY 1, 2, 3
HAVING COUNT(*) > CASE tier WHEN 'auth' THEN 20 WHEN 'heavy' THEN 30 WHEN 'api' THEN 120 ELSE 200 END""")
KEYS = "cloud_provider, account_id, usage_date, service_name, sku_description, region, resource_group"
oracle("stream_upsert_costs", f"""SELECT cloud_provider, usage_date, COUNT(*) AS row_count, {r('SUM(cost_usd)', 2)} AS cost_usd FROM (SELECT {KEYS}, SUM(cost_usd) * CASE WHEN {within(2)} THEN 2 ELSE 1 END AS cost_usd FROM v_cloud_costs GROUP BY 1, 2, 3, 4, 5, 6, 7) GROUP BY 1, 2""")
from oracle.anomaly_sql import A2  # noqa: E402

oracle("stream_spend_alerts", A2)
