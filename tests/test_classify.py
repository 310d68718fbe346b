import datetime as dt

import pytest
from pyspark.sql import functions as F

from spendscope.functions import classify as C
from spendscope.functions.features import FEATURES, anomaly_features


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


SKUS = {
    "PREMIUM_ALL_PURPOSE_COMPUTE": ("All Purpose Compute", "Interactive Cluster", "cluster"),
    "JOBS_SQL": ("Jobs Compute", "SQL Warehouse", "warehouse"),
    "SERVERLESS_SQL_X": ("SQL Warehouse", "Serverless SQL", "warehouse"),
    "DELTA_LIVE_CORE": ("Delta Live Tables", "DLT Pipeline", "pipeline"),
    "SERVERLESS_REAL_TIME_INFERENCE": ("Other", "Serverless Inference", "other"),
    "MODEL_SERVING": ("Model Serving", "Model Serving", "other"),
    "VECTOR_SEARCH_X": ("Vector Search", "Vector Search", "other"),
    "INTERNET_EGRESS": ("Other", "Egress", "other"),
}


def test_sku_rules_and_their_order(spark):
    df = spark.createDataFrame([(s,) for s in SKUS], "sku string")
    s = F.col("sku")
    got = {r[0]: tuple(r)[1:] for r in df.select("sku", C.product_category(s), C.product_category_fine(s), C.resource_type(s)).collect()}
    assert got == SKUS


def test_origin_labels(spark):
    rows = [("jobs",), (None,), ("",), ("LAKE_FLOW",)]
    assert values(spark, C.origin_product_label(F.col("c")), rows, "c string") == ["Jobs Compute", "Other", "", "Lake Flow"]
    assert values(spark, C.infra_category(F.col("c")), rows, "c string") == ["Jobs", "Other", "", "Lake Flow"]


def test_env_tier(spark):
    rows = [
        ("prod-etl", {"ENV": "QA"}, "x", ("test", "qa", "tag")),          # a tag beats the name
        ("nonprod-1", {}, "x", ("dev", "nonprod", "name")),
        ("latest-job", {}, "prod", ("test", "test", "name")),              # "latest" contains "test"
        ("etl", {"env": "weird"}, "Prod-EU", ("prod", "prod", "workspace")),
        ("etl", None, None, (None, None, None)),
        ("etl", {"team": "prod"}, "", (None, None, None)),
        ("x-production", {}, "", ("prod", "production", "name")),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "n string, t map<string,string>, w string")
    tier = C.env_tier(F.col("n"), F.col("t"), F.col("w"))
    got = [(r.tier, r.label, r.source) for r in df.select("*", F.inline(F.array(tier))).collect()]
    assert got == [r[3] for r in rows]
    assert values(spark, C.env_from_workspace(F.col("w")), [("nonprod",), ("dev-1",), ("zz",)], "w string") == ["prod", "dev", "other"]


def test_service_principals(spark):
    rows = [("1234@9001",), ("12-34_5@x",), ("0a1b2c3d-0a1b-0a1b-0a1b-0a1b2c3d4e5f@x",), ("",), (None,), ("ann@example.com",), ("a-b-c-d-e@x",)]
    assert values(spark, C.is_service_principal(F.col("e")), rows, "e string") == [True, True, True, True, True, False, False]


def test_human_filter(spark):
    rows = [("a@example.com",), (" ",), (None,), ("x@vendor.example",)]
    assert values(spark, F.coalesce(C.is_human(F.col("e"), "vendor.example"), F.lit(False)), rows, "e string") == [True, False, False, False]


@pytest.mark.parametrize("hours,tier,job,want", [
    (8.0, "dev", False, "critical"), (7.99, "dev", False, "warning"), (3.99, "dev", False, "info"), (4.0, "dev", True, "critical"),
    (71.9, "prod", False, "warning"), (24.0, "prod", True, "critical"), (-1.0, "other", False, "info"),
])
def test_severity(spark, hours, tier, job, want):
    col = C.severity_by_duration(F.col("h"), F.col("t"), F.col("j"))
    assert values(spark, col, [(hours, tier, job)], "h double, t string, j boolean") == [want]


def test_blank_ids_count_as_absent(spark):
    rows = [(("", "wh", None, None),), ((None, "", "run", "p"),), ((None, None, None, None),)]
    schema = "usage_metadata struct<cluster_id:string,warehouse_id:string,job_run_id:string,dlt_pipeline_id:string>"
    assert values(spark, C.resource_id(), rows, schema) == ["wh", "run", None]


def test_resource_path_priority(spark):
    ids = ("warehouse_id", "dlt_pipeline_id", "endpoint_name", "endpoint_id", "job_id", "job_run_id", "cluster_id", "notebook_id")
    cases = [
        ({"warehouse_id": "w", "job_id": "j"}, "SQL Warehouse", "sql/warehouses/w"), ({"job_id": "j", "job_run_id": "r"}, "Jobs", "#job/j/run/r"),
        ({"job_id": "j"}, "Jobs", "#job/j"), ({"job_run_id": "r"}, "Jobs", "#job/runs/r"), ({"cluster_id": "c"}, "Jobs Cluster", "#setting/clusters/c/configuration"),
        ({"cluster_id": "c"}, "Other", "#setting/clusters/c"), ({}, "Model Serving", "ml/endpoints"), ({"notebook_id": "n"}, "Other", "#notebook/n"), ({}, "Other", ""),
    ]
    df = spark.createDataFrame([(*[c[0].get(i) for i in ids], c[1]) for c in cases], ", ".join(f"{i} string" for i in ids) + ", product string")
    assert [r[0] for r in df.select(C.resource_path(F.col("product"))).collect()] == [c[2] for c in cases]


def test_features_floor_the_duration(spark):
    cols = anomaly_features(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(6), F.lit(7), F.lit("job"))
    row = spark.range(1).select(*cols).first()
    assert [row[f] for f in FEATURES] == pytest.approx([0, 0, 0.00995033, 1, 0, 0, 1, 2], abs=1e-6)


def test_contract_year():
    from spendscope.plans.executive import contract_year_start

    assert contract_year_start(dt.date(2024, 7, 31)) == dt.date(2023, 8, 1)
    assert contract_year_start(dt.date(2024, 8, 1)) == dt.date(2024, 8, 1)
