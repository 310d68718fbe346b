"""Small hand-made frames in the logical schemas."""

import datetime as dt

from pyspark.sql import functions as F

from spendscope.sources.schemas import SCHEMAS


def ts(text):
    return dt.datetime.fromisoformat(text)


def usage(spark, rows):
    """Rows are dicts; start and end are texts, ids and tags optional."""
    flat = []
    for r in rows:
        start = ts(r["start"])
        end = ts(r["end"]) if "end" in r else start + dt.timedelta(hours=1)
        flat.append((
            r.get("workspace", "ws-1"), r.get("sku", "PRO_SQL"), r.get("cloud", "AWS"), start, end, float(r.get("qty", 1)),
            r.get("cluster"), r.get("warehouse"), r.get("job"), r.get("run"), r.get("pipeline"), r.get("tags", {}),
        ))
    df = spark.createDataFrame(flat, """workspace_id string, sku_name string, cloud string, usage_start_time timestamp,
        usage_end_time timestamp, qty double, cluster_id string, warehouse_id string, job_id string, job_run_id string,
        dlt_pipeline_id string, custom_tags map<string,string>""")
    none = F.lit(None).cast("string")
    ids = [F.nullif(c, F.lit("")).alias(c) for c in ("cluster_id", "warehouse_id", "job_id", "job_run_id", "dlt_pipeline_id")]
    extra = [none.alias(c) for c in ("notebook_id", "endpoint_name", "endpoint_id")]
    return df.select(
        "workspace_id", "sku_name", "cloud", "usage_start_time", "usage_end_time",
        F.to_date("usage_start_time").alias("usage_date"), F.col("qty").cast("decimal(18,4)").alias("usage_quantity"),
        F.lit("COMPUTE_TIME").alias("usage_type"), F.lit("SQL").alias("billing_origin_product"), "custom_tags",
        F.struct(none.alias("run_as"), none.alias("created_by")).alias("identity_metadata"),
        F.struct(*ids, *extra).alias("usage_metadata"),
    )


def prices(spark, rows):
    """(sku, cloud, start, end or None, price)"""
    data = [(s, c, ts(a), ts(b) if b else None, float(p)) for s, c, a, b, p in rows]
    df = spark.createDataFrame(data, "sku_name string, cloud string, price_start_time timestamp, price_end_time timestamp, p double")
    return df.select("sku_name", "cloud", "price_start_time", "price_end_time", F.struct(F.col("p").cast("decimal(18,6)").alias("default")).alias("pricing"))


def flat_price(spark, price=1.0, sku="PRO_SQL"):
    return prices(spark, [(sku, "AWS", "2000-01-01", None, price)])


def workspaces(spark, rows):
    """(id, name, subscription, group)"""
    data = [(i, n, f"https://{i}", "RUNNING", "AWS", "EU", s, g) for i, n, s, g in rows]
    return spark.createDataFrame(data, SCHEMAS["access.workspaces_latest"])
