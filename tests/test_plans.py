import datetime as dt

import pytest
from pyspark.sql import functions as F

from spendscope.plans import alerts, anomaly, executive, query_attribution
from spendscope.plans.adoption import adoption_summary, inactive_users
from spendscope.plans.compute import clusters_latest
from spendscope.plans import BUNDLES, REPORTS, bundle
from spendscope.plans.cost import cost_summary, filter_options, spike_resources
from spendscope.plans.running import running_anomalies
from spendscope.sources.schemas import SCHEMAS
from tests.helpers import flat_price, ts, usage, workspaces

TODAY = dt.date(2024, 3, 31)


def spend(spark, costs, sku="PRO_SQL"):
    """costs: day offset back from TODAY -> cost at price 1"""
    return usage(spark, [{"start": str(TODAY - dt.timedelta(days=d)), "qty": c, "sku": sku, "warehouse": "w"} for d, c in costs.items()])


def money_ctx(spark, ctx_of, u, **kw):
    return ctx_of(TODAY, {"billing.usage": u, "billing.list_prices": flat_price(spark), "access.workspaces_latest": workspaces(spark, [("ws-1", "prod-1", "s", "g")])}, **kw)


def test_summary_of_nothing_is_zero(spark, ctx_of):
    row = cost_summary(money_ctx(spark, ctx_of, spend(spark, {90: 1}))).first()
    assert (row.workspace_count, row.product_count, row.units, row.cost) == (0, 0, 0.0, 0.0)


def test_window_counts_both_ends(spark, ctx_of):
    row = cost_summary(money_ctx(spark, ctx_of, spend(spark, {31: 100, 30: 10, 0: 1, -1: 1000}))).first()
    assert row.cost == 11.0


def test_filter_options_offer_named_subscriptions(spark, ctx_of):
    ctx = money_ctx(spark, ctx_of, spend(spark, {1: 1}), subscription_names={"S": "Main", "other": "Spare"})
    got = sorted((r.kind, r.id, r.name) for r in filter_options(ctx).collect())
    assert got == [("resource_group", "g", "g"), ("subscription", "other", "Spare"), ("subscription", "s", "Main"), ("workspace", "ws-1", "prod-1")]


def test_bundles_name_registered_reports(spark):
    assert {s for sections in BUNDLES.values() for s in sections} <= set(REPORTS)
    from spendscope.sources.testdata import testdata_ctx

    pages = bundle(testdata_ctx(spark, "/root/testdata/sf0.001"), "cost")
    assert list(pages) == list(BUNDLES["cost"]) and pages["cost_summary"].count() == 1


def test_top_resources_per_workspace(spark, ctx_of):
    u = usage(spark, [{"start": str(TODAY), "warehouse": f"w{i:02}", "qty": i} for i in range(1, 31)] + [{"start": str(TODAY), "qty": 99}])
    got = spike_resources(money_ctx(spark, ctx_of, u)).orderBy("rank").collect()
    assert len(got) == 20 and got[0].resource_id == "w30" and got[-1].resource_id == "w11"


# ---- forecasts ----


def test_forecast_needs_seven_days_and_never_goes_negative(spark, ctx_of):
    assert executive.forecast_7d(money_ctx(spark, ctx_of, spend(spark, {d: 5 for d in range(6)}))).count() == 0
    flat = executive.forecast_7d(money_ctx(spark, ctx_of, spend(spark, {d: 5 for d in range(10)}))).collect()
    assert [r.cost for r in flat] == [5.0] * 7 and flat[0].forecast_date == TODAY + dt.timedelta(days=1)
    assert flat[0].forecast_pct_change == 0.0
    falling = executive.forecast_7d(money_ctx(spark, ctx_of, spend(spark, {d: 1 + 10 * d for d in range(7)}))).collect()
    # last seven days 61, 51, ..., 1: mean 31, slope -10
    assert [r.cost for r in sorted(falling, key=lambda r: r.forecast_date)] == [21.0, 11.0, 1.0, 0.0, 0.0, 0.0, 0.0]


def test_projection_falls_back_to_the_average(spark, ctx_of):
    day = dt.date(2024, 3, 21)
    u = usage(spark, [{"start": str(day - dt.timedelta(days=d)), "qty": 7} for d in range(4)])
    ctx = ctx_of(day, {"billing.usage": u, "billing.list_prices": flat_price(spark)})
    row = executive.month_end_projection(ctx).first()
    assert (row.method, row.days_remaining, row.month_to_date, row.projected_month_end) == ("average", 10, 28.0, 48.0)


def test_run_rate_weights_recent_days(spark, ctx_of):
    row = executive.run_rate(money_ctx(spark, ctx_of, spend(spark, {0: 20, 20: 10}))).first()
    assert (row.total_usage, row.run_rate_per_day, row.forecasted_run_rate, row.forecast_pct_change) == (30.0, 15.0, 16.0, 6.7)
    empty = executive.run_rate(money_ctx(spark, ctx_of, spend(spark, {90: 1}))).first()
    assert (empty.total_usage, empty.run_rate_per_day, empty.forecasted_run_rate) == (0.0, 0.0, 0.0)


@pytest.mark.parametrize("first,second,growth,forecast", [(100, 10, -50.0, 5.0), (10, 100, 200.0, 300.0), (100, 120, 20.0, 144.0), (0, 50, None, 50.0)])
def test_yearly_growth_is_clamped(spark, ctx_of, first, second, growth, forecast):
    day = dt.date(2024, 8, 15)
    rows = [{"start": s, "qty": q} for s, q in (("2022-09-10", first), ("2023-09-10", second)) if q]
    row = executive.annual_forecast(ctx_of(day, {"billing.usage": usage(spark, rows), "billing.list_prices": flat_price(spark)})).first()
    assert (row.cy1_cost, row.cy2_cost, row.yoy_growth_pct, row.yoy_forecast_cost) == (first, second, growth, forecast)
    assert (row.cy1_label, row.forecast_label, row.cy_current_months) == ("Aug 2022 - Jul 2023", "Aug 2025 - Jul 2026", 0)


# ---- alerts ----


def kinds(df):
    return sorted((r.type, r.severity, r.subject, r.pct_change) for r in df.collect())


def test_spend_alerts(spark, ctx_of):
    steady = {d: 10 for d in range(7, 31)}
    exact = money_ctx(spark, ctx_of, spend(spark, {**steady, **{d: 12 for d in range(7)}}))
    assert kinds(alerts.alert_spend_spike(exact)) == []                               # exactly 20 %
    # "Last seven days" holds eight dates, the week before seven: 94 against 70.
    assert kinds(alerts.alert_report(exact)) == [("SKU_GROWTH", "MEDIUM", "PRO_SQL", 34.3)]
    got = kinds(alerts.alert_spend_spike(money_ctx(spark, ctx_of, spend(spark, {**steady, **{d: 12.5 for d in range(7)}}))))
    assert got == [("SPEND_SPIKE", "MEDIUM", "all", 25.0)]
    got = kinds(alerts.alert_report(money_ctx(spark, ctx_of, spend(spark, {**steady, **{d: 10 for d in range(1, 7)}, 0: 20.0}))))
    assert not [k for k in got if k[0] == "DAILY_SPIKE"]                              # exactly twice
    got = kinds(alerts.alert_daily_spike(money_ctx(spark, ctx_of, spend(spark, {**steady, **{d: 10 for d in range(1, 7)}, 0: 20.01}))))
    assert got == [("DAILY_SPIKE", "HIGH", "2024-03-31", None)]


def test_sku_alerts(spark):
    rows = [("new", "p", 10.01, 0.0), ("small", "p", 10.0, 0.0), ("grow", "p", 131.0, 100.0), ("slow", "p", 130.0, 100.0), ("gone", "p", 0.0, 50.0)]
    wow = spark.createDataFrame(rows, "sku_name string, billing_origin_product string, cost_7d double, cost_prior_7d double")
    assert kinds(alerts.new_skus(wow)) == [("NEW_SKU", "MEDIUM", "new", None)]
    assert kinds(alerts.growing_skus(wow, 20.0)) == [("SKU_GROWTH", "MEDIUM", "grow", 31.0)]


# ---- anomalies ----


def drift_of(spark, costs, missing_today=False):
    rows = [("k", TODAY - dt.timedelta(days=d + missing_today), float(c)) for d, c in enumerate(costs)]
    df = spark.createDataFrame(rows, "k string, usage_date date, cost double")
    got = anomaly.drift(df, ["k"], TODAY).collect()
    return (got[0].alert_type, got[0].pct_change, got[0].severity) if got else None


def test_drift_rules(spark):
    assert drift_of(spark, [100] + [1] * 5) is None                                  # six rows are skipped
    assert drift_of(spark, [100] + [1] * 6) == ("cost_spike", 560.4, "critical")     # no prior rows needed
    assert drift_of(spark, [12] + [5] * 6) is None                                   # 12 against a mean of 6: exactly twice
    assert drift_of(spark, [13, 5, 5, 5, 5, 5, 5]) == ("cost_spike", 111.6, "critical")
    assert drift_of(spark, [4] * 7 + [3] * 3) == ("cost_trend", 33.3, "warning")     # short prior week
    assert drift_of(spark, [4] * 7 + [3] * 7 + [100] * 5) == ("cost_trend", 33.3, "warning")
    assert drift_of(spark, [100] + [1] * 6, missing_today=True) is None              # newest row is not today


def test_baseline_needs_five_days_and_z_is_one_sided(spark):
    hist = [("a", "cluster", float(u), float(u), 1.0) for u in (1, 2, 3, 4, 5)] + [("b", "cluster", 1.0, 1.0, 1.0)] * 4
    df = spark.createDataFrame(hist, "resource_id string, resource_type string, units double, cost double, duration_hours double")
    base = anomaly.baselines(df)
    row = base.first()
    assert (base.count(), row.resource_id, row.p50_units, row.std_duration_hours) == (1, "a", 3.0, 0.001)
    assert row.std_units == pytest.approx(2**0.5)
    run = spark.createDataFrame([("a", 0.0, 3.0 + 2 * 2**0.5, 1.0), ("b", 9.0, 9.0, 9.0)], "resource_id string, units double, cost double, duration_hours double")
    got = {r.resource_id: r for r in anomaly.zscores(run, base).collect()}
    assert got["a"].z_units == 0.0 and got["a"].max_z == pytest.approx(2.0) and got["b"].max_z is None


def test_running_resources(spark, ctx_of):
    rows = [
        ("Cluster", "c1", "adhoc", "ws-9", {}, ts("2024-03-30T20:00")), ("Cluster", "c2", "adhoc", "ws-9", {}, ts("2024-03-30T20:00:01")),
        ("SQL Warehouse", "w", "bi-dev", "ws-9", {}, None), ("Job Run", "r", "nightly", "ws-9", {"env": "prod"}, ts("2024-03-29T23:00")),
        ("DLT Pipeline", "p", "uat-flow", "ws-9", {}, ts("2024-03-01T00:00")),
    ]
    running = spark.createDataFrame(rows, "service_type string, resource_id string, name string, workspace_id string, tags map<string,string>, started_at timestamp")
    u = usage(spark, [{"start": "2024-03-30T10:00", "end": "2024-03-30T12:00", "warehouse": "w", "qty": 4}])
    none = spark.createDataFrame([], "warehouse_id string, event_time timestamp, event_type string")
    ctx = ctx_of(TODAY, {
        "live.running_resources": running, "billing.usage": u, "billing.list_prices": flat_price(spark), "compute.warehouse_events": none,
        "access.workspaces_latest": workspaces(spark, [("ws-9", "main", "s", "g")]),
    })
    got = {r.resource_id: (r.environment, r.env_tier, r.detected_by, r.duration_hours, r.anomaly_level, r.cost) for r in running_anomalies(ctx).collect()}
    assert got == {
        "c1": ("unknown", "other", "duration", 4.0, "warning", None),
        "w": ("dev", "dev", "name", 14.0, "critical", 4.0),
        "r": ("prod", "prod", "tag", 25.0, "critical", None),
        "p": ("uat", "uat", "name", -1.0, "info", None),
    }


def test_attribution_without_any_duration_is_zero(spark, ctx_of):
    rows = [("s1", "u", "u", ("w",), "SELECT", "q", ts("2024-03-30T10:00"), 0, 1, 1, None), ("s2", "v", "svc", ("w",), "SELECT", "q", ts("2024-03-30T10:00"), 0, 1, 1, None)]
    history = spark.createDataFrame(rows, SCHEMAS["query.history"])
    ctx = ctx_of(TODAY, {"query.history": history, "billing.usage": spend(spark, {1: 10}), "billing.list_prices": flat_price(spark)})
    got = query_attribution.user_cost_attribution(ctx).collect()
    assert [(r.user_email, r.cost_90d) for r in got] == [("u", 0.0)]


def test_attribution_shares_by_all_query_time(spark, ctx_of):
    rows = [(f"s{i}", by, run, ("w",), "SELECT", "q", ts("2024-03-30T10:00"), ms, 1, 1, None) for i, (by, run, ms) in enumerate([("a", "a", 300), ("b", "b", 100), ("svc", "x", 600)])]
    history = spark.createDataFrame(rows, SCHEMAS["query.history"])
    ctx = ctx_of(TODAY, {"query.history": history, "billing.usage": spend(spark, {1: 10}), "billing.list_prices": flat_price(spark)})
    got = {r.user_email: r.cost_30d for r in query_attribution.user_cost_attribution(ctx).collect()}
    assert got == {"a": 3.0, "b": 1.0}


def test_clusters_deleted_and_created_again(spark, ctx_of):
    def version(cid, name, source, changed, deleted=None):
        return (cid, name, "ws-1", "o", source, "12", "n", "n", 1, 1, 0, ts(changed), ts(deleted) if deleted else None)

    rows = [
        version("a", "x", "UI", "2024-01-01"), version("a", "x", "UI", "2024-01-02", "2024-01-02"),
        version("b", "x", None, "2024-01-01", "2024-01-01"), version("b", "y", None, "2024-01-02"),
        version("c", "dlt-execution-1", "UI", "2024-01-01"), version("d", "x", "JOB", "2024-01-01"),
    ]
    ctx = ctx_of(TODAY, {"compute.clusters": spark.createDataFrame(rows, SCHEMAS["compute.clusters"])})
    assert [(r.cluster_id, r.cluster_name) for r in clusters_latest(ctx).collect()] == [("b", "y")]


def test_inactive_users(spark, ctx_of):
    def event(email, days):
        at = dt.datetime.combine(TODAY - dt.timedelta(days=days), dt.time(9))
        return ("ws", at, at.date(), "ip", "ua", (email,), "svc", "act", {}, (200,), "e")

    rows = [event("old@x", 31), event("edge@x", 30), event("new@x", 0), event("12@34", 60), event(" ", 1), event("out@x", 91)]
    ctx = ctx_of(TODAY, {"access.audit": spark.createDataFrame(rows, SCHEMAS["access.audit"])})
    assert [(r.user_email, r.days_inactive) for r in inactive_users(ctx).collect()] == [("old@x", 31)]
    row = adoption_summary(ctx).first()
    assert tuple(row) == (3, 1, 2, 1, 1)


def test_scope_of_a_user(spark, ctx_of):
    from spendscope.plans.labels import ctx_for_user

    rows = [("Ann@x", '{"workspaces": ["ws-1", "ws-1"]}'), ("bob@x", '{"workspaces": ["*"]}'), ("cy@x", "oops"), ("di@x", '{"workspaces": []}')]
    config = spark.createDataFrame([(e, c, None, "me") for e, c in rows], SCHEMAS["platform.user_permissions"])
    ctx = ctx_of(tables={"platform.user_permissions": config})
    assert [r.workspace_id for r in ctx_for_user(ctx, " ANN@x ").allowed_workspaces.collect()] == ["ws-1"]
    assert all(ctx_for_user(ctx, e).allowed_workspaces is None for e in ("bob@x", "cy@x", "nobody@x"))
    assert ctx_for_user(ctx, "di@x").allowed_workspaces.count() == 0


def test_deleted_tasks_stay_deleted(spark, ctx_of):
    day = lambda n: dt.datetime(2024, 1, n)
    tasks = spark.createDataFrame(
        [("ws-1", "j", "a", day(1), None), ("ws-1", "j", "a", day(2), day(2)), ("ws-1", "j", "b", day(1), None)],
        "workspace_id string, job_id string, task_key string, change_time timestamp, delete_time timestamp",
    )
    ctx = ctx_of(tables={"lakeflow.job_tasks": tasks, "access.workspaces_latest": workspaces(spark, [("ws-1", "prod one", "s", "g")])})
    assert [r.task_count for r in REPORTS["job_task_counts"](ctx).collect()] == [1]


def test_schedule_of_a_job_report_does_not_depend_on_the_order_of_versions(spark, ctx_of):
    """two versions of a job that tie in all but their schedule."""
    at = lambda h: dt.datetime(2024, 3, 30, h)
    versions = [("ws-1", "j", "etl", "a@x", "b@x", at(1), at(2), None, ("0 0 8 * * ?", s)) for s in ("PAUSED", "UNPAUSED")]
    runs = spark.createDataFrame(
        [("ws-1", "j", "r1", at(3), at(4), "SUCCEEDED", "JOB_RUN")],
        "workspace_id string, job_id string, run_id string, period_start_time timestamp, period_end_time timestamp, result_state string, run_type string",
    )
    tasks = spark.createDataFrame([("ws-1", "j", "a", at(1), None)], "workspace_id string, job_id string, task_key string, change_time timestamp, delete_time timestamp")
    for rows in (versions, versions[::-1]):
        jobs = spark.createDataFrame(rows, """workspace_id string, job_id string, name string, creator_user_name string, run_as_user_name string, created_time timestamp,
            change_time timestamp, delete_time timestamp, schedule struct<quartz_cron_expression string, pause_status string>""").coalesce(1)
        ctx = ctx_of(tables={
            "lakeflow.jobs": jobs, "lakeflow.job_run_timeline": runs, "lakeflow.job_tasks": tasks,
            "access.workspaces_latest": workspaces(spark, [("ws-1", "prod one", "s", "g")]),
        })
        assert [(r.schedule_status, r.total_runs, r.task_count) for r in REPORTS["job_report"](ctx).collect()] == [("UNPAUSED", 1, 1)]


def test_reports_read_their_tables_few_times(spark):
    """Grants and their principals, running resources and the parts of the summaries are evaluated once a report."""
    from spendscope.plans import REPORTS
    from spendscope.sources.testdata import testdata_ctx

    ctx = testdata_ctx(spark, "/root/testdata/sf0.001")
    most = {
        "principal_map": (14, 16), "principal_summary": (10, 14), "permission_edges": (11, 13), "anomaly_summary": (31, 13),
        "compute_summary": (19, 13),
    }
    for name, (scans, exchanges) in most.items():
        plan = REPORTS[name](ctx)._jdf.queryExecution().executedPlan().toString()
        assert (plan.count("FileScan") <= scans, plan.count("Exchange hashpartitioning") <= exchanges) == (True, True), (
            name, plan.count("FileScan"), plan.count("Exchange hashpartitioning"))
