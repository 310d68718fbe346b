import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from spendscope import Catalog
from spendscope.sources import ingest, permissions, quality
from spendscope.sources.catalog import first_col, first_nonempty
from spendscope.sources.schemas import SCHEMAS
from spendscope.sources.sinks import (
    COST_KEYS,
    SHARED_DIR,
    shared_folder,
    upsert,
    upsert_partitions,
    write_partitioned,
)
from tests.helpers import prices


def test_names_resolve_by_entry_area_and_root(spark, tmp_path):
    c = Catalog(spark, {"a.b": "x.y"}, areas={"billing": "fin", "logs": "/data/logs"}, root="/lake")
    assert [c.resolve(n) for n in ("a.b", "billing.usage", "logs.audit", "other.t")] == ["x.y", "fin.usage", "/data/logs/audit", "/lake/other/t"]


def test_absent_tables(spark, tmp_path):
    c = Catalog(spark, {"billing.usage": str(tmp_path / "no/where"), "access.audit": "no_such_table"})
    for name in ("billing.usage", "access.audit"):
        empty = c.table(name, optional=True)
        assert empty.count() == 0 and set(empty.columns) == set(spark.createDataFrame([], SCHEMAS[name]).columns)
        with pytest.raises(AnalysisException):
            c.table(name).count()


def test_every_schema_parses(spark):
    for ddl in SCHEMAS.values():
        assert spark.createDataFrame([], ddl).columns


def test_column_drift_and_fallback(spark):
    df = spark.createDataFrame([(None, "b"), ("a", "b")], "endpoint_name string, status string")
    got = df.select(first_col(df, "name", "endpoint_name"), first_col(df, "state", "status"), first_col(df, "zone")).collect()
    assert [tuple(r) for r in got] == [("", "b", ""), ("a", "b", "")]
    assert first_nonempty(df.limit(0), df).count() == 2 and first_nonempty(df, df.limit(0)).count() == 2


def _costs(spark, rows):
    schema = "cloud_provider string, account_id string, usage_date date, service_name string, sku_description string, region string, resource_group string, cost_usd double"
    return spark.createDataFrame([("aws", a, dt.date(2024, 1, d), "s", "k", "r", g, float(c)) for a, d, g, c in rows], schema)


def test_upsert_is_idempotent_with_null_keys(spark):
    base, load = _costs(spark, [("a", 1, None, 1), ("b", 1, "g", 2)]), _costs(spark, [("a", 1, None, 9), ("c", 2, None, 3)])
    once = upsert(base, load, COST_KEYS)
    twice = upsert(once, load, COST_KEYS)
    for df in (once, twice):
        assert sorted((r.account_id, r.cost_usd) for r in df.collect()) == [("a", 9.0), ("b", 2.0), ("c", 3.0)]
    assert upsert(base, load.limit(0), COST_KEYS).count() == 2
    gone = upsert(base, load.limit(0), COST_KEYS, deletes=base.where("account_id = 'a'"))
    assert [r.account_id for r in gone.collect()] == ["b"]


def test_upsert_rewrites_only_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "costs")
    write_partitioned(_costs(spark, [("a", 1, "g", 1), ("b", 2, "g", 2)]), path)
    before = set(p.name for p in (tmp_path / "costs/cloud_provider=aws/usage_date=2024-01-01").iterdir())
    upsert_partitions(spark, path, _costs(spark, [("b", 2, "g", 7), ("d", 2, "g", 1)]))
    assert before == set(p.name for p in (tmp_path / "costs/cloud_provider=aws/usage_date=2024-01-01").iterdir())
    assert sorted((r.account_id, r.cost_usd) for r in spark.read.parquet(path).collect()) == [("a", 1.0), ("b", 7.0), ("d", 1.0)]


def test_upsert_refuses_what_it_cannot_keep_unique(spark, tmp_path):
    path = str(tmp_path / "costs")
    write_partitioned(_costs(spark, [("a", 1, "g", 1)]), path)
    with pytest.raises(ValueError, match="more than one row"):
        upsert_partitions(spark, path, _costs(spark, [("b", 2, "g", 7), ("b", 2, "g", 1)]))
    with pytest.raises(ValueError, match="among the keys"):
        upsert_partitions(spark, path, _costs(spark, [("b", 2, "g", 7)]), keys=("account_id",))


def test_upsert_matches_null_partitions(spark, tmp_path):
    path = str(tmp_path / "costs")
    first = _costs(spark, [("a", 1, "g", 1), ("b", 2, "g", 2)]).withColumn("usage_date", F.when(F.col("account_id") != "a", F.col("usage_date")))
    write_partitioned(first, path)
    upsert_partitions(spark, path, first.withColumn("cost_usd", F.col("cost_usd") * 10))
    assert sorted((r.account_id, r.cost_usd) for r in spark.read.parquet(path).collect()) == [("a", 10.0), ("b", 20.0)]


def test_shared_folder_needs_a_setting():
    session = lambda **conf: SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: conf.get(key, default)))
    with pytest.raises(ValueError):
        shared_folder(session(), "x")
    assert shared_folder(session(**{SHARED_DIR: "s3://lake/"}), "x").startswith("s3://lake/x-")
    assert shared_folder(session(**{SHARED_DIR: "/a", "spark.checkpoint.dir": "/b"}), "x").startswith("/b/x-")


def test_permissions(spark):
    rows = [
        ("Ann@X", '{"tabs": ["cost"], "tags": [{"key": "Team", "value": "a"}, {"Product": "b"}]}'), ("bob@x", "{}"), ("cy@x", "oops"),
        ("di@x", '{"tabs": ['),
    ]
    df = spark.createDataFrame([(e, c, None, "me") for e, c in rows], SCHEMAS["platform.user_permissions"])
    got = {r.email: r for r in permissions.parse_permissions(df).collect()}
    assert [(t.key, t.value) for t in got["ann@x"].tags] == [("Team", "a"), ("Product", "b")]
    assert [got[e].is_valid for e in ("ann@x", "bob@x", "cy@x", "di@x")] == [True, True, False, False]
    assert got["bob@x"].allowed_tabs is None and got["cy@x"].tags == []
    assert permissions.permissions_of(df, " ANN@x ").count() == 1


def test_permission_batch(spark):
    now = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    current = spark.createDataFrame([("A@x", "1", None, "o"), ("b@x", "2", None, "o")], SCHEMAS["platform.user_permissions"])
    changes = spark.createDataFrame(
        [("a@X", "old", "me", 1), ("A@x", "new", "me", 2), ("B@x", None, "me", 1), ("c@x", "3", "me", 1), ("d@x", None, "me", 1)],
        "email string, config string, updated_by string, change_no int",
    )
    got = sorted((r.email, r.config, r.updated_by) for r in permissions.upsert_permissions(current, changes, now).collect())
    assert got == [("a@x", "new", "me"), ("c@x", "3", "me")]


def test_unit_price_and_window(spark):
    df = spark.createDataFrame([(1.0, 3.0), (5.0, 0.0), (0.0, 2.0)], "c double, q double")
    assert [r[0] for r in df.select(ingest.unit_price(F.col("c"), F.col("q"))).collect()] == [0.33333333, 0.0, 0.0]
    assert ingest.ingest_window(dt.date(2024, 3, 1), 2) == (dt.date(2024, 2, 28), dt.date(2024, 2, 29))


def test_gcp_credits(spark):
    row = ("p", None, dt.datetime(2024, 1, 1), "BigQuery", "sku", "h", 2.0, 10.0, "USD", None, None)
    df = spark.createDataFrame([row + ([(-1.0,), (-0.5,)],), row + (None,)], """project_id string, project_name string, usage_start_time timestamp,
        service_description string, sku_description string, pricing_unit string, usage_amount double, cost double, currency string,
        location_region string, location_name string, credits array<struct<amount:double>>""")
    got = ingest.normalize_gcp(df, "2024-01-02 00:00:00").collect()
    assert [(r.cost_usd, r.usage_quantity, r.unit_price, r.region, r.account_name, r.service_category) for r in got] == [(18.5, 4.0, 4.625, "global", "p", "Analytics")]


def test_formats(spark):
    df = spark.createDataFrame([("ws-1_A",), ("ws 1",), ("",), (None,), ("x" * 65,)], "v string")
    assert [r[0] for r in df.select(quality.matches(F.col("v"), quality.WORKSPACE_ID)).collect()] == [True, False, False, False, False]
    mails = spark.createDataFrame([("A.b@x.io",), ("1234@9001",), ("a@b",), ("a\n@x.io",), (None,)], "v string")
    assert [tuple(r) for r in mails.select(F.coalesce(quality.is_email(F.col("v")), F.lit(False)), quality.is_identity(F.col("v"))).collect()] == [
        (True, True), (False, True), (False, True), (False, False), (False, False)]
    nums = spark.createDataFrame([("1",), ("100",), ("0.5",), ("x",), (None,)], "v string")
    assert [r[0] for r in nums.select(quality.is_threshold(F.col("v"))).collect()] == [True, True, False, False, False]
    days = spark.createDataFrame([(dt.date(2024, 1, 2),), (dt.date(2024, 1, 3),), (dt.date(2020, 1, 1),)], "v date")
    assert [r[0] for r in days.select(quality.is_plausible_day(F.col("v"), dt.date(2024, 1, 1))).collect()] == [True, False, False]
    tabs = spark.createDataFrame([(["Cost", " ai "],), (["nope"],), (None,)], "v array<string>")
    assert [r[0] for r in tabs.select(quality.is_tab_list(F.col("v"))).collect()] == [True, False, True]


def test_overlapping_prices(spark):
    p = prices(spark, [("a", "x", "2024-01-01", "2024-02-01", 1), ("a", "x", "2024-02-01", None, 1), ("b", "x", "2024-01-01", None, 1), ("b", "x", "2024-03-01", None, 1)])
    assert [r.sku_name for r in quality.overlapping_prices(p).collect()] == ["b"]


def test_split_counts_and_parts_rows_in_one_pass(spark, tmp_path):
    rows = [(1, "a", 5), (2, "b c", 5), (3, None, 50), (4, "d", None), (5, "e", 7)]
    df = spark.createDataFrame(rows, "id int, name string, n int").repartition(3)
    rules = {"name": quality.matches(F.col("name"), quality.IDENTIFIER), "small": F.col("n") < 10}
    parts = quality.split(df, rules, f"{tmp_path}/out")
    assert parts.results == [("name", 3, 2), ("small", 3, 2)]
    assert sorted(r.id for r in parts.accepted.collect()) == [1, 5] and parts.accepted.columns == df.columns
    assert sorted((r.id, *r.broken_rules) for r in parts.quarantined.collect()) == [(2, "name"), (3, "name", "small"), (4, "small")]
    clean = quality.split(df.limit(0), rules, f"{tmp_path}/none")
    assert clean.results == [("name", 0, 0), ("small", 0, 0)] and clean.accepted.count() == clean.quarantined.count() == 0


def test_every_rule_is_broken_and_kept(spark, tmp_path):
    from spendscope.plans.inputs import dq_validate
    from spendscope.sources.testdata import testdata_ctx

    spark.conf.set(SHARED_DIR, str(tmp_path))
    found = dq_validate(testdata_ctx(spark, "/root/testdata/sf0.001")).collect()
    assert len(found) == 17 and all(r.passed > 0 and r.failed > 0 for r in found)
