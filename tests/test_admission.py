"""The request limiter against a plain definition row by row, and the reports built on it."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from spendscope.functions.documents import field, is_broken, parsed
from spendscope.operators.admission import OUTCOMES, Gate, Rules, admissions
from spendscope.plans import anomaly
from tests.helpers import ts

RULES = Rules({"auth": (5, 4), "api": (9, 8)}, failures=4, violations=3)
START = ts("2024-03-30T10:00:00")


def plain(requests, rules):
    """Outcome of each request of one client, and when bans begin, by lists that are never pruned."""
    bursts, passed, broken, failed, until, out, bans = [], [], [], [], 0, [], []
    inside = lambda times, now, seconds: [t for t in times if now - t < seconds * 1_000_000]
    for now, tier, denied, blocked in requests:
        limit, burst = rules.limits[tier]
        if now < until:
            out.append("banned")
            continue
        if blocked:
            out.append("blocked")
        elif len(inside([t for t, x in bursts if x == tier], now, rules.burst_window)) >= burst:
            out.append("burst")
        else:
            bursts.append((now, tier))
            if len(inside([t for t, x in passed if x == tier], now, rules.window)) >= limit:
                out.append("rate")
            else:
                passed.append((now, tier))
                out.append("denied" if denied else "accepted")
        marks, seconds, most = (failed, rules.failure_window, rules.failures) if out[-1] == "denied" else (broken, rules.violation_window, rules.violations)
        if out[-1] != "accepted":
            marks.append(now)
            if len(inside(marks, now, seconds)) >= most:
                marks.clear()
                until = now + rules.ban * 1_000_000
                bans.append(now)
    return out, bans


def log(seed, n=600):
    """Three clients, one of them in clumps and with most rows; times may repeat."""
    rng, rows = random.Random(seed), []
    for client, share, gap in (("busy", n, 2), ("calm", n // 6, 400), ("odd", n // 6, 15)):
        at = 0
        for i in range(share):
            at += gap if client == "calm" else rng.choice([0, 0, 0, 1, gap, gap, 20 * gap if client == "busy" and i % 97 == 0 else gap])
            rows.append((client, START + dt.timedelta(seconds=at), f"{client}-{i:05d}", rng.choice(["auth", "api", "api"]), client != "calm" and rng.random() < 0.1, rng.random() < 0.03))
    return rows


def expected(rows, rules):
    out = {}
    for client in {r[0] for r in rows}:
        mine = sorted(((int((r[1] - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000, r[2], *r[3:]) for r in rows if r[0] == client))
        outcomes, bans = plain([(m[0], *m[2:]) for m in mine], rules)
        out[client] = (*(outcomes.count(o) for o in OUTCOMES), len(bans), *((bans[0], bans[-1]) if bans else (None, None)))
    return out


def found(df):
    rows = df.select("*", F.unix_micros("first_ban").alias("a"), F.unix_micros("last_ban").alias("b")).collect()
    return {r["client"]: (*(r[o] for o in OUTCOMES), r["bans"], r["a"], r["b"]) for r in rows}


@pytest.mark.parametrize(("piece_rows", "partitions"), [(50_000, 1), (40, 5), (7, 3)])
def test_pieces_of_clients_give_what_rows_give(spark, tmp_path, piece_rows, partitions):
    rows = log(piece_rows, 200 if piece_rows == 7 else 600)
    shuffled = random.Random(1).sample(rows, len(rows))
    df = spark.createDataFrame(shuffled, "client string, event_time timestamp, request_id string, tier string, denied boolean, blocked boolean")
    result = admissions(df, RULES, f"{tmp_path}/work", piece_rows, partitions)
    want = expected(rows, RULES)
    assert found(result) == want
    assert piece_rows == 7 or all(any(w[k] for w in want.values()) for k in range(len(OUTCOMES)))
    assert {w[6] > 0 for w in want.values()} == {True, False}
    pieces = spark.read.parquet(f"{tmp_path}/work/pieces").where("client = 'busy'")
    assert partitions == 1 or (pieces.select("stretch").distinct().count() > 1 and pieces.count() > partitions)


def test_state_survives_being_written():
    rng = random.Random(3)
    whole, parts, now = Gate(RULES), Gate(RULES), 10**12
    for _ in range(500):
        now += rng.choice([0, 1, 10, 100]) * 1_000_000
        request = (now, rng.choice(["auth", "api"]), rng.random() < 0.3, rng.random() < 0.05)
        parts = Gate.load(RULES, parts.dump(now))
        assert whole.admit(*request) == parts.admit(*request)
    assert Gate.load(RULES, whole.dump(now + 10**10)).dump(now) is None


def test_empty_log(spark, tmp_path):
    df = spark.createDataFrame([], "client string, event_time timestamp, request_id string, tier string, denied boolean, blocked boolean")
    assert admissions(df, RULES, f"{tmp_path}/work").count() == 0


def test_reasons_of_suspicion(spark, ctx_of):
    heads = [
        ('{"user-agent": "Mozilla/5.0", "accept": "*/*"}', "notebook", None), ('{"user-agent": "curl/8.0"}', "notebook", "bot_user_agent"),
        ('{"accept": "*/*"}', "notebook", "missing_user_agent"), ('{"user-agent": "Mozilla/5.0"}', "notebook", "missing_accept_header"),
        ('{"user-agent": "Mozilla/5.0"}', "dashboards", None), ("{broken", "notebook", "unreadable_headers"), (None, "notebook", "missing_user_agent"),
        (json.dumps({"user-agent": 5, "accept": "x"}), "notebook", None), ("[]", "dashboards", "missing_user_agent"),
    ]
    rows = [(f"q{i}", f"c{i}", START, service, 200, head) for i, (head, service, _) in enumerate(heads)]
    table = spark.createDataFrame(rows, "request_id string, client string, event_time timestamp, service_name string, status_code int, headers string")
    found = {r["client"]: r["reason"] for r in anomaly.suspicion(anomaly.requests(table)).collect()}
    assert found == {f"c{i}": reason for i, (_, _, reason) in enumerate(heads)}
    report = anomaly.suspicious_agents(ctx_of(tables={"platform.request_log": table}))
    assert {(r["client"], r["reason"]) for r in report.collect()} == {(c, x) for c, x in found.items() if x}


def test_fields_of_documents(spark):
    texts = ['{"a": {"b": [1, "x"]}}', '{"a": null}', "{", None, "7", '{"a": {"b": "no list"}}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(field(parsed("t"), "$.a.b[0]", "int").alias("n"), field(parsed("t"), "$.a.b[1]").alias("s"), is_broken("t").alias("broken")).collect()
    assert [tuple(r) for r in rows] == [(1, "x", False), (None, None, False), (None, None, True), (None, None, False), (None, None, False), (None, None, False)]
