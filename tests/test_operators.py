import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendscope.operators.filters import UsageFilter, WorkspaceNotAllowed, filter_usage
from spendscope.operators.iforest import IsolationForest, grow_tree
from spendscope.operators.pricing import join_effective_price
from spendscope.operators.quantiles import exact_percentiles
from spendscope.operators.rates import sliding_counts, trailing_count, trailing_totals
from spendscope.operators.sessions import event_session_start, last_sessions
from spendscope.operators.versions import latest_version
from tests.helpers import flat_price, prices, ts, usage, workspaces


def test_price_window_is_closed_at_start_and_open_at_end(spark):
    p = prices(spark, [
        ("PRO_SQL", "AWS", "2024-01-01", "2024-02-01", 1.0), ("PRO_SQL", "AWS", "2024-02-01", None, 2.0),
        ("JOBS", "AWS", "2024-01-01", "2024-02-01", 5.0),
    ])
    u = usage(spark, [
        {"start": "2024-01-01", "qty": 3}, {"start": "2024-02-01", "qty": 3}, {"start": "2023-12-31T23:59:59", "qty": 3},
        {"start": "2024-02-01", "sku": "JOBS", "qty": 3}, {"start": "2024-01-05", "sku": "NONE"}, {"start": "2024-01-05", "cloud": "GCP"},
    ])
    got = [(float(r.price), float(r.cost), r.is_priced) for r in join_effective_price(u, p).collect()]
    assert sorted(got) == sorted([(1, 3, True), (2, 6, True), (0, 0, False), (0, 0, False), (0, 0, False), (0, 0, False)])


def test_latest_version_ranks_before_it_drops_deleted(spark):
    rows = [
        ("a", 1, None, "x"), ("a", 2, 2, "x"),                     # deleted last
        ("b", 1, 1, "x"), ("b", 2, None, "y"),                     # deleted, then created again
        ("c", 5, None, "m"), ("c", 5, None, "n"),                  # tie: the greater name
    ]
    df = spark.createDataFrame(rows, "id string, change_time int, delete_time int, name string")
    assert {(r.id, r.name) for r in latest_version(df, ["id"]).collect()} == {("b", "y"), ("c", "n")}
    assert latest_version(df, ["id"], drop_deleted=False).count() == 3


def test_versions_that_differ_in_nested_columns_alone_are_ranked(spark):
    """of jobs that tie in all plain columns, the order of the input decided the schedule."""
    kind = "id string, change_time int, delete_time int, schedule struct<cron string, pause_status string>, tags map<string, string>, runs array<struct<n int>>"
    rows = [
        ("a", 1, None, ("8", "PAUSED"), {"env": "prod"}, [(1,)]), ("a", 1, None, ("8", "UNPAUSED"), {"env": "prod"}, [(1,)]),
        ("b", 1, None, ("8", "PAUSED"), {"env": "dev"}, [(2,)]), ("b", 1, None, ("8", "PAUSED"), {"env": "prod"}, [(2,)]),
        ("c", 1, None, ("8", "PAUSED"), {"env": "dev"}, [(1,)]), ("c", 1, None, ("8", "PAUSED"), {"env": "dev"}, [(3,)]),
        ("d", 1, 1, ("8", "PAUSED"), {"env": "dev"}, [(1,)]), ("d", 1, None, ("8", "UNPAUSED"), {"env": "dev"}, [(1,)]),  # deletion first
    ]
    found = [
        {r.id: (r.schedule.pause_status, r.tags["env"], r.runs[0].n) for r in latest_version(spark.createDataFrame(part, kind).coalesce(1), ["id"]).collect()}
        for part in (rows, rows[::-1])
    ]
    assert found[0] == found[1] == {"a": ("UNPAUSED", "prod", 1), "b": ("PAUSED", "prod", 2), "c": ("PAUSED", "dev", 3)}


def _sessions(spark, rows, gap=3600):
    u = join_effective_price(usage(spark, rows), flat_price(spark))
    u = u.withColumn("warehouse_id", F.col("usage_metadata.warehouse_id"))
    return {r.warehouse_id: (r.session_start, float(r.units), r.row_count) for r in last_sessions(u, "warehouse_id", gap).collect()}


def test_session_gap_of_exactly_an_hour_continues(spark):
    rows = [
        {"warehouse": "w1", "start": "2024-01-01T10:00", "end": "2024-01-01T11:00"},
        {"warehouse": "w1", "start": "2024-01-01T12:00", "end": "2024-01-01T12:30"},
        {"warehouse": "w2", "start": "2024-01-01T10:00", "end": "2024-01-01T11:00"},
        {"warehouse": "w2", "start": "2024-01-01T12:00:01", "end": "2024-01-01T12:30"},
    ]
    got = _sessions(spark, rows)
    assert got["w1"] == (ts("2024-01-01T10:00"), 2.0, 2)
    assert got["w2"] == (ts("2024-01-01T12:00:01"), 1.0, 1)


def test_session_across_midnight(spark):
    rows = [{"warehouse": "w", "start": "2024-01-01T08:00", "end": "2024-01-01T09:00"}] + [
        {"warehouse": "w", "start": f"2024-01-0{d}T{h:02}:30", "end": f"2024-01-0{d}T{h:02}:59"} for d, h in ((1, 22), (1, 23), (2, 0), (2, 1))
    ]
    assert _sessions(spark, rows)["w"] == (ts("2024-01-01T22:30"), 4.0, 4)


def test_sessions_equal_a_plain_scan(spark):
    rnd, rows = random.Random(7), []
    for w in range(6):
        t = ts("2024-01-01T00:00")
        for _ in range(60):
            t += dt.timedelta(minutes=rnd.choice([5, 20, 61, 90, 600, 2000]))
            rows.append({"warehouse": f"w{w}", "start": t.isoformat(), "end": (t + dt.timedelta(minutes=rnd.randint(1, 70))).isoformat()})
    got = _sessions(spark, rows)
    for w in range(6):
        mine = sorted((ts(r["start"]), ts(r["end"])) for r in rows if r["warehouse"] == f"w{w}")
        start, prev = None, None
        for a, b in mine:
            if prev is None or (a - prev).total_seconds() > 3600:
                start = a
            prev = b
        n = sum(a >= start for a, _ in mine)
        assert got[f"w{w}"] == (start, float(n), n)


def test_event_session_ignores_trailing_stop(spark):
    def ev(w, *pairs):
        return [(w, ts(f"2024-01-01T{h:02}:00"), e) for h, e in pairs]

    rows = (
        ev("a", (1, "RUNNING"), (2, "STOPPED"), (3, "STARTING"), (4, "RUNNING"), (5, "SCALED_UP"), (6, "RUNNING"), (7, "STOPPED"))
        + ev("b", (1, "STARTING"), (9, "RUNNING")) + ev("c", (1, "STOPPED"))
    )
    df = spark.createDataFrame(rows, "warehouse_id string, event_time timestamp, event_type string")
    got = {r.warehouse_id: r.session_start.hour for r in event_session_start(df).collect()}
    assert got == {"a": 3, "b": 1}


def test_exact_percentiles_match_numpy_under_skew(spark):
    rnd = random.Random(3)
    data = {"hot": [rnd.choice([5.0, 5.0, 7.5]) for _ in range(900)] + [rnd.uniform(-50, 1e6) for _ in range(100)],
            "two": [1.0, 2.0], "one": [3.0], None: [0.0, -4.0, 9.0]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs] + [("two", None)], "k string, v double")
    wanted = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r.k: r for r in exact_percentiles(df, ["k"], "v", wanted).collect()}
    assert set(got) == set(data)
    for k, vs in data.items():
        for name, q in wanted.items():
            assert got[k][name] == pytest.approx(np.quantile(vs, q), rel=1e-12, abs=1e-9)
    whole = exact_percentiles(df, [], "v", {"p50": 0.5}).first()["p50"]
    assert whole == pytest.approx(np.quantile([v for vs in data.values() for v in vs], 0.5))


def _events(spark):
    rnd = random.Random(5)
    base = ts("2024-01-01T00:00")
    rows = [(rnd.choice("abb"), base + dt.timedelta(milliseconds=rnd.randint(0, 400_000))) for _ in range(300)]
    return rows, spark.createDataFrame(rows, "k string, t timestamp")


def test_trailing_count_equals_brute_force(spark):
    rows, df = _events(spark)
    got = sorted((r.k, r.t, r.trailing) for r in trailing_count(df, ["k"], "t", 30).collect())
    span = dt.timedelta(seconds=30)
    want = sorted((k, t, sum(k2 == k and t - span < t2 <= t for k2, t2 in rows)) for k, t in rows)
    assert got == want


def test_sliding_counts_equal_the_window_function(spark):
    _, df = _events(spark)
    got = {(r.k, r.window_start): r.n for r in sliding_counts(df, ["k"], "t", 60, 5).collect()}
    plain = df.groupBy("k", F.window("t", "60 seconds", "5 seconds").alias("w")).count()
    assert got == {(r.k, r.w.start): r["count"] for r in plain.collect()}


def test_usage_filter(spark, ctx_of):
    u = usage(spark, [
        {"start": "2024-03-30", "workspace": "ws-1", "tags": {"Team": "a"}}, {"start": "2024-03-30", "workspace": "ws-2"},
        {"start": "2024-04-01", "workspace": "ws-1"}, {"start": "2024-02-29", "workspace": "ws-3", "tags": {"Team": "b"}},
    ])
    dim = workspaces(spark, [("ws-1", "a", "Sub-A", "RG-X"), ("ws-2", "b", "sub-b", "rg-y"), ("ws-3", "c", "sub-b", "rg-y")])
    ctx = ctx_of(tables={"billing.usage": u, "access.workspaces_latest": dim})

    def ids(**p):
        return sorted(r.workspace_id for r in filter_usage(ctx, UsageFilter(**p)).collect())

    assert ids() == ["ws-1", "ws-2"]
    assert ids(start=dt.date(2024, 2, 29)) == ["ws-1", "ws-2", "ws-3"]
    assert ids(workspaces=["ws-2"]) == ["ws-2"]
    assert ids(subscriptions=["SUB-a"]) == ["ws-1"]
    by_name = ctx.with_(subscription_names={"sub-b": "Sandbox"})
    assert [r.workspace_id for r in filter_usage(by_name, UsageFilter(subscriptions=["sandbox"])).collect()] == ["ws-2"]
    assert ids(resource_group="RG-Y") == ["ws-2"]
    assert ids(subscriptions=["nowhere"]) == []
    assert ids(tag_key="Team") == ["ws-1"]
    assert ids(tag_key="Team", tag_value="b") == []
    scoped = ctx.with_(allowed_workspaces=spark.createDataFrame([("ws-2",)], "workspace_id string"))
    assert [r.workspace_id for r in filter_usage(scoped, UsageFilter()).collect()] == ["ws-2"]
    with pytest.raises(WorkspaceNotAllowed):
        filter_usage(scoped, UsageFilter(workspaces=["ws-1"]))
    everyone = ctx.with_(allowed_workspaces=spark.createDataFrame([("*",)], "workspace_id string"))
    assert filter_usage(everyone, UsageFilter()).count() == 2


def test_forest_is_repeatable_and_ranks_the_outlier_first(spark):
    rng = np.random.default_rng(1)
    data = [(i, *map(float, rng.normal(0, 1, 2))) for i in range(400)] + [(999, 9.0, -9.0)]
    df = spark.createDataFrame(data, "id int, x double, y double")
    forest = IsolationForest(("x", "y"), trees=40, sample=64)
    model = forest.fit(df, ["id"])
    scores = {r.id: r.if_score for r in model.transform(df).collect()}
    assert max(scores, key=scores.get) == 999 and scores[999] >= 0.5
    assert all(0.0 <= s <= 1.0 for s in scores.values())
    again = forest.fit(df.repartition(7), ["id"])
    assert {r.id: r.if_score for r in again.transform(df).collect()} == scores
    assert len(model.node_table) <= 40 * 127
    assert forest.fit(df.limit(29), ["id"]) is None


def test_tree_isolates_every_distinct_row():
    nodes = grow_tree(0, np.array([[1.0], [1.0], [2.0], [3.0]]), 42)
    leaves = nodes[nodes.feature < 0]
    assert leaves["size"].sum() == 4
    assert nodes[nodes.feature >= 0][["left", "right"]].min().min() > 0


def test_trailing_totals_of_a_burst_client(spark):
    """A client that floods for a minute, and one whose events lie just beside a window."""
    start = dt.datetime(2024, 1, 1)
    rows = [("flood", start + dt.timedelta(seconds=50 + k / 4)) for k in range(240)] + [("slow", start), ("slow", start + dt.timedelta(seconds=60))]
    df = spark.createDataFrame(rows, "k string, t timestamp")
    got = {(r.k, r.second): r.trailing for r in trailing_totals(df, ["k"], "t", 60).collect()}
    per = {}
    for k, t in rows:
        per[k, int(t.timestamp())] = per.get((k, int(t.timestamp())), 0) + 1
    assert got == {(k, s): sum(n for (j, u), n in per.items() if j == k and s - 59 <= u <= s) for k, s in per}
    assert max(got.values()) == 240
