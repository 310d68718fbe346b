"""Anomalies of resources: baselines, isolation forest, cost drift, idleness; and of API clients."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendscope.context import Ctx, day_start
from spendscope.functions import classify as C
from spendscope.functions.documents import field, is_broken, parsed
from spendscope.functions.features import FEATURES, anomaly_features
from spendscope.functions.measures import desc, hours_between, rnd, total
from spendscope.operators import sketches
from spendscope.operators.admission import Rules, admissions
from spendscope.operators.iforest import NODE_SCHEMA, IsolationForest, IsolationForestModel
from spendscope.operators.pricing import priced_usage
from spendscope.operators.rates import trailing_totals
from spendscope.plans.cost import with_workspace
from spendscope.plans.registry import report
from spendscope.plans.running import running_anomalies
from spendscope.sources.catalog import empty
from spendscope.sources.sinks import shared_folder, write_partitioned

HISTORY_DAYS, DRIFT_DAYS = 90, 30
MIN_SESSIONS = 5
Z_LIMIT = 2.0
IDLE_HOURS, IDLE_CRITICAL_HOURS = 1.5, 4.0
SPIKE_FACTOR, TREND_FACTOR = 2.0, 1.3
DRIFT_KEYS = (
    "workspace_id", "product", "resource_id", "product_tag", "env_tag", "subscription_tag", "resource_group_tag",
)
# Running service kinds as resource types.
RESOURCE_TYPE_OF = {"SQL Warehouse": "warehouse", "Cluster": "cluster", "Job Run": "job", "DLT Pipeline": "pipeline"}


# ---- history and baselines ----


@report("resource_history")
def resource_history(ctx: Ctx) -> DataFrame:
    """One row per resource, type, day and workspace; usage without a resource id is left out."""
    rid = C.resource_id()
    start, end = F.min("usage_start_time"), F.max("usage_end_time")
    return priced_usage(ctx, HISTORY_DAYS).where(rid.isNotNull()).groupBy(
        rid.alias("resource_id"), C.resource_type(F.col("sku_name")).alias("resource_type"), "usage_date", "workspace_id"
    ).agg(
        total("usage_quantity", 4).alias("units"), total("cost", 4).alias("cost"),
        rnd(hours_between(start, end), 3).alias("duration_hours"),
        F.min(F.hour("usage_start_time")).alias("start_hour"), F.min(F.dayofweek("usage_start_time")).alias("weekday"),
    )


def baselines(history: DataFrame) -> DataFrame:
    """Median and spread per resource over its days; a resource has at most a few hundred of them."""
    def median(c: str) -> Column:
        return F.percentile(c, 0.5).alias(f"p50_{c}")

    def spread(c: str) -> Column:
        return F.greatest(F.stddev_pop(c), F.lit(0.001)).alias(f"std_{c}")

    measures = ("units", "cost", "duration_hours")
    return history.groupBy("resource_id").agg(
        F.count("*").alias("session_count"), F.min("resource_type").alias("resource_type"),
        *[f(c) for c in measures for f in (median, spread)],
    ).where(F.col("session_count") >= MIN_SESSIONS)


@report("baseline_profile")
def baseline_profile(ctx: Ctx) -> DataFrame:
    rows = baselines(resource_history(ctx))
    return rows.withColumns({c: rnd(c, 6) for c in rows.columns if c.startswith(("p50_", "std_"))})


MEASURES = ("units", "cost", "duration_hours")


@report("baseline_sketched")
def baseline_sketched(ctx: Ctx) -> DataFrame:
    """Medians per resource from sketches that are kept of each day and merged over the window."""
    path = shared_folder(ctx.spark, "baseline-sketches")
    write_partitioned(sketches.of_days(resource_history(ctx), ["resource_id"], "usage_date", MEASURES), path, ("usage_date",))
    kept, out = ctx.spark.read.parquet(path), None
    for c in MEASURES:
        marks = sketches.quantiles(kept, ["resource_id"], c, {f"median_{c}": 0.5})
        out = marks if out is None else out.join(marks.drop("row_count"), "resource_id")
    return out.where(F.col("row_count") >= MIN_SESSIONS).withColumnRenamed("row_count", "session_count")


def zscores(running: DataFrame, profile: DataFrame) -> DataFrame:
    """One-sided distance from the median in spreads for each measure, and the largest."""
    rows = running.join(profile.drop("resource_type"), "resource_id", "left")

    def z(c: str) -> Column:
        value = F.coalesce(F.col(c), F.lit(0.0))
        return F.when(F.col("session_count").isNotNull(), F.greatest((value - F.col(f"p50_{c}")) / F.col(f"std_{c}"), F.lit(0.0)))

    rows = rows.withColumns({f"z_{c}": z(c) for c in ("duration_hours", "cost", "units")})
    return rows.withColumn("max_z", F.greatest("z_duration_hours", "z_cost", "z_units"))


def _z_hit() -> Column:
    return F.col("max_z") >= Z_LIMIT


def _z_score() -> Column:
    return rnd(F.least(F.col("max_z") / 5, F.lit(1.0)), 3)


@report("baseline_zscore")
def baseline_zscore(ctx: Ctx) -> DataFrame:
    """Running resources at least two spreads above their median in duration, cost or units."""
    rows = zscores(running_anomalies(ctx), baselines(resource_history(ctx))).where(_z_hit())
    return rows.select(
        "resource_id", "name", rnd("z_duration_hours", 2).alias("z_duration"), rnd("z_cost", 2).alias("z_cost"),
        rnd("z_units", 2).alias("z_units"), rnd("max_z", 2).alias("max_z_score"), _z_score().alias("score"),
    )


# ---- isolation forest ----


def training_rows(ctx: Ctx) -> DataFrame:
    cols = [F.col(c) for c in ("units", "cost", "duration_hours", "start_hour", "weekday", "resource_type")]
    keys = ("resource_id", "resource_type", "usage_date", "workspace_id")
    return resource_history(ctx).select(*keys, *anomaly_features(*cols))


FOREST = IsolationForest(FEATURES)
TRAINING_ID = ("resource_id", "resource_type", "usage_date", "workspace_id")


@report("anomaly_features")
def feature_rows(ctx: Ctx) -> DataFrame:
    rows = training_rows(ctx)
    return rows.withColumns({f: rnd(f, 6) for f in FEATURES})


@report("iforest_train")
def iforest_train(ctx: Ctx) -> DataFrame:
    """The model as a table of tree nodes; empty when there are fewer than 30 training rows."""
    rows = training_rows(ctx)
    row_count = rows.count()
    if row_count < FOREST.min_rows:
        return empty(ctx.spark, NODE_SCHEMA)
    return FOREST.nodes(rows, TRAINING_ID, row_count)


@report("iforest_trees")
def iforest_trees(ctx: Ctx) -> DataFrame:
    """Per tree: rows it was grown from, rows in its leaves, and whether it keeps its depth limit."""
    leaf, limit = F.col("feature") < 0, math.ceil(math.log2(FOREST.sample))
    return iforest_train(ctx).groupBy("tree").agg(
        F.max(F.when(F.col("node") == 0, F.col("size"))).cast("bigint").alias("sampled_rows"),
        F.sum(F.when(leaf, F.col("size"))).alias("leaf_rows"), (F.max("depth") <= limit).alias("depth_in_limit"),
    )


def _running_features(ctx: Ctx) -> DataFrame:
    started = F.col("started_at")
    cols = (
        F.coalesce("units", F.lit(0.0)), F.coalesce("cost", F.lit(0.0)),
        F.greatest(F.coalesce("duration_hours", F.lit(0.0)), F.lit(0.0)), F.coalesce(F.hour(started), F.lit(12)),
        F.coalesce(F.dayofweek(started), F.lit(3)),
        F.coalesce(C.lookup(F.col("service_type"), RESOURCE_TYPE_OF), F.lit("other")),
    )
    return running_anomalies(ctx).select("*", *anomaly_features(*cols))


def _scored(ctx: Ctx, model: IsolationForestModel | None = None) -> DataFrame:
    rows = _running_features(ctx)
    model = model or FOREST.fit(training_rows(ctx), TRAINING_ID)
    scored = model.transform(rows) if model else rows.withColumn("if_score", F.lit(None).cast("double"))
    return scored.withColumn("if_score", rnd("if_score", 3)).drop(*FEATURES)


@report("iforest_score")
def iforest_score(ctx: Ctx) -> DataFrame:
    return _scored(ctx).select("resource_id", "service_type", "name", "if_score", (F.col("if_score") >= 0.5).alias("is_anomaly"))


@report("iforest_checks")
def iforest_checks(ctx: Ctx) -> DataFrame:
    """Per running resource: whether its score is in range and its flag follows from it."""
    score = F.col("if_score")
    return iforest_score(ctx).select(
        "resource_id", "service_type", "name", F.coalesce(score.between(0, 1), F.lit(False)).alias("score_in_range"),
        F.coalesce(F.col("is_anomaly") == (score >= 0.5), F.lit(False)).alias("flag_follows"),
    )


@report("resource_anomalies")
def resource_anomalies(ctx: Ctx) -> DataFrame:
    """Running resources flagged by their baseline or by the forest, scored by the stronger of the two."""
    rows = zscores(_scored(ctx), baselines(resource_history(ctx)))
    by_z, by_if = F.when(_z_hit(), _z_score()), F.when(F.col("if_score") >= 0.5, F.col("if_score"))
    rows = rows.withColumns({"baseline_score": by_z, "forest_score": by_if})
    rows = rows.where("baseline_score IS NOT NULL OR forest_score IS NOT NULL").withColumn(
        "ml_score", F.greatest("baseline_score", "forest_score")
    )
    layers = F.array_compact(F.array(
        F.when(F.col("baseline_score").isNotNull(), F.lit("baseline")),
        F.when(F.col("forest_score").isNotNull(), F.lit("isolation_forest")),
    ))
    severity = F.when(F.col("ml_score") >= 0.7, "critical").when(F.col("ml_score") >= 0.4, "warning").otherwise("info")
    return rows.select(
        "resource_id", "service_type", "name", "workspace_id", "workspace_name", "environment", "env_tier", "started_at",
        "duration_hours", "units", "cost", "baseline_score", "forest_score", "ml_score", severity.alias("severity"),
        F.array_join(layers, ",").alias("detected_by_layers"), rnd("max_z", 2).alias("max_z_score"), "session_count",
        rnd("p50_duration_hours", 2).alias("median_duration_hours"), rnd("p50_units", 3).alias("median_daily_units"),
        rnd("p50_cost", 3).alias("median_daily_cost"),
    ).orderBy(desc("ml_score"), "name")


# ---- drift ----


@report("daily_cost_by_resource")
def daily_cost_by_resource(ctx: Ctx) -> DataFrame:
    tags = {
        "product_tag": "product", "env_tag": "environment", "subscription_tag": "subscription",
        "resource_group_tag": "resource_group",
    }
    return priced_usage(ctx, DRIFT_DAYS).groupBy(
        "workspace_id", "usage_date", C.drift_product(F.col("sku_name")).alias("product"),
        C.resource_id().alias("resource_id"), *[C.tag_alias(kind).alias(name) for name, kind in tags.items()],
    ).agg(total("cost", 4).alias("cost"), total("usage_quantity", 4).alias("units"))


def drift(daily: DataFrame, keys: Sequence[str], today) -> DataFrame:
    """Spikes and upward trends of a daily cost series per key.

    The newest seven rows against the seven (or fewer) before them; rows, not calendar days. Today above
    twice the recent mean, today included, is a spike; otherwise a recent mean more than 30 % above the
    prior one is a trend. Keys with fewer than seven rows are skipped.
    """
    newest = Window.partitionBy(*keys).orderBy(desc("usage_date"))
    rn, cost = F.col("_rn"), F.col("cost")
    sums = daily.withColumn("_rn", F.row_number().over(newest)).where(rn <= 14).groupBy(*keys).agg(
        F.count("*").alias("_n"), F.avg(F.when(rn <= 7, cost)).alias("_recent"), F.avg(F.when(rn > 7, cost)).alias("_prior"),
        F.max(F.when((rn == 1) & (F.col("usage_date") == F.lit(today)), cost)).alias("_today"),
    ).where("_n >= 7")
    now, recent, prior = F.col("_today"), F.col("_recent"), F.col("_prior")
    spike = (now > 0) & (recent > 0.01) & (now > recent * SPIKE_FACTOR)
    trend = (prior > 0.01) & (recent > prior * TREND_FACTOR)
    kind = F.when(spike, "cost_spike").when(trend, "cost_trend")
    pct = F.when(spike, rnd((now - recent) * 100 / recent, 1)).otherwise(rnd((recent - prior) * 100 / prior, 1))
    rows = sums.withColumn("alert_type", kind).where("alert_type IS NOT NULL").withColumn("pct_change", pct)
    critical = (F.col("alert_type") == "cost_spike") & (F.col("pct_change") > 100)
    return rows.select(
        *keys, "alert_type", rnd(now, 2).alias("today_cost"), rnd(recent, 2).alias("recent_avg"),
        rnd(prior, 2).alias("prior_avg"), "pct_change", F.when(critical, "critical").otherwise("warning").alias("severity"),
    ).orderBy(desc("pct_change"))


@report("drift_alerts")
def drift_alerts(ctx: Ctx) -> DataFrame:
    return drift(daily_cost_by_resource(ctx), DRIFT_KEYS, ctx.day())


@report("join_alert_context")
def join_alert_context(ctx: Ctx) -> DataFrame:
    """Drift per workspace, subscription and group, with blanks filled from the workspace's own."""
    keys = ("workspace_id", "subscription_tag", "resource_group_tag")
    daily = daily_cost_by_resource(ctx).groupBy(*keys, "usage_date").agg(F.sum("cost").alias("cost"))
    rows = with_workspace(ctx, drift(daily, keys, ctx.day()), "workspace_name", "subscription_id", "resource_group")
    return rows.withColumns({
        "subscription": F.coalesce(F.nullif("subscription_tag", F.lit("")), "subscription_id"),
        "resource_group": F.coalesce(F.nullif("resource_group_tag", F.lit("")), "resource_group"),
    }).drop("subscription_tag", "resource_group_tag", "subscription_id")


# ---- idle resources ----


@report("last_billing")
def last_billing(ctx: Ctx) -> DataFrame:
    rid = C.resource_id()
    return ctx.recent("billing.usage", "usage_date", 2).where(rid.isNotNull()).groupBy(rid.alias("resource_id")).agg(
        F.max("usage_end_time").alias("last_billing_end")
    )


def _with_idleness(ctx: Ctx) -> DataFrame:
    since = (F.unix_timestamp(day_start(ctx.day())) - F.unix_timestamp("last_billing_end")) / 3600.0
    idle = F.coalesce(since.cast("double"), "duration_hours", F.lit(0.0))
    return running_anomalies(ctx).join(last_billing(ctx), "resource_id", "left").withColumn("_idle", idle)


@report("idle_resources")
def idle_resources(ctx: Ctx) -> DataFrame:
    """Running but not billed for 1.5 hours or more; never billed counts from the start."""
    rows = _with_idleness(ctx)
    return rows.where(F.col("_idle") >= IDLE_HOURS).select(
        "resource_id", "service_type", "name", "workspace_name", "environment", "started_at", "duration_hours",
        "last_billing_end", rnd("_idle", 1).alias("idle_hours"),
        F.when(F.col("_idle") >= IDLE_CRITICAL_HOURS, "critical").otherwise("warning").alias("severity"),
    ).orderBy(desc("idle_hours"), "name")


@report("anomaly_summary")
def anomaly_summary(ctx: Ctx) -> DataFrame:
    by_resource = resource_history(ctx).groupBy("resource_id").agg(F.count("*").alias("_n"))
    history = by_resource.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("training_records"), F.count_if(F.col("_n") >= MIN_SESSIONS).alias("resources_with_baseline")
    )
    running = _with_idleness(ctx).agg(F.count("*").alias("running_resources"), F.count_if(F.col("_idle") >= IDLE_HOURS).alias("idle_resources"))
    drifting = drift_alerts(ctx).agg(F.count("*").alias("drift_alerts"))
    # One row a part, put together by a sum: each part is evaluated once.
    rows = history.unionByName(running, allowMissingColumns=True).unionByName(drifting, allowMissingColumns=True)
    return rows.agg(*(F.sum(c).alias(c) for c in rows.columns)).withColumns({
        "training_window_days": F.lit(HISTORY_DAYS), "forest_trained": F.col("training_records") >= FOREST.min_rows,
    })


# ---- API clients ----

# Requests allowed per minute and per five seconds, and services by tier.
RATE_LIMITS = {"auth": (20, 5), "heavy": (30, 5), "api": (120, 20), "static": (200, 40)}
TIER_OF_SERVICE = {"accounts": "auth", "iamService": "heavy", "dashboards": "static"}
# Fixed value: agents that are taken for bots.
BOT_PATTERN = (
    r"python-requests|httpx|curl/|wget/|scrapy|bot|spider|crawl|headless|phantom|selenium|puppeteer|playwright|httrack"
    r"|nikto|sqlmap|nmap|masscan|nuclei|gobuster|dirbuster|ffuf|burp"
)


def request_tier(service: Column) -> Column:
    return F.coalesce(C.lookup(service, TIER_OF_SERVICE), F.lit("api"))


def rate_limit(tier: Column, burst: bool) -> Column:
    return C.lookup(tier, {t: str(pair[1 if burst else 0]) for t, pair in RATE_LIMITS.items()}).cast("int")


RULES = Rules(RATE_LIMITS)
LOG = "platform.request_log"


def requests(log: DataFrame) -> DataFrame:
    """client, tier, event_time, request_id, status_code and, from the JSON headers, agent, accept and headers_broken."""
    headers = parsed("headers")
    return log.select(
        "client", request_tier(F.col("service_name")).alias("tier"), "event_time", "request_id", "status_code",
        F.coalesce(field(headers, "$['user-agent']"), F.lit("")).alias("agent"), F.coalesce(field(headers, "$.accept"), F.lit("")).alias("accept"),
        is_broken("headers").alias("headers_broken"),
    )


def suspicion(rows: DataFrame) -> DataFrame:
    """``requests`` with the reason why an agent looks like no browser, NULL if it does not.

    Headers that are no JSON are a reason of their own. Only calls of the API must say what they accept.
    """
    bot, api = F.lower("agent").rlike(BOT_PATTERN), F.col("tier") != "static"
    reason = (
        F.when(F.col("headers_broken"), "unreadable_headers").when(F.col("agent") == "", "missing_user_agent")
        .when(bot, "bot_user_agent").when(api & (F.col("accept") == ""), "missing_accept_header")
    )
    return rows.withColumn("reason", reason)


def _recent_requests(ctx: Ctx) -> DataFrame:
    return requests(ctx.recent_ts(LOG, "event_time", 30))


@report("request_rate_violations")
def request_rate_violations(ctx: Ctx) -> DataFrame:
    """Per client and tier: busiest minute and five seconds, and the seconds at which they were over the limit."""
    rows = _recent_requests(ctx)

    def side(seconds: int, burst: bool) -> DataFrame:
        over = F.col("trailing") > rate_limit(F.col("tier"), burst)
        return trailing_totals(rows, ["client", "tier"], "event_time", seconds).groupBy("client", "tier").agg(
            F.max("trailing").alias(f"peak_{seconds}s"), F.count_if(over).alias(f"violations_{seconds}s")
        )

    return side(60, False).join(side(5, True), ["client", "tier"])


@report("failure_ban_candidates")
def failure_ban_candidates(ctx: Ctx, rules: Rules = RULES) -> DataFrame:
    """What a limiter with these rules would have done to each client: outcomes of its requests, bans and what led there."""
    rows = suspicion(_recent_requests(ctx)).select(
        "client", "event_time", "request_id", "tier", F.coalesce(F.col("status_code") == 403, F.lit(False)).alias("denied"),
        (F.col("reason").isNotNull() & (F.col("tier") != "static")).alias("blocked"),
    )
    return admissions(rows, rules, shared_folder(ctx.spark, "admission")).withColumn("is_candidate", F.col("bans") > 0)


@report("suspicious_agents")
def suspicious_agents(ctx: Ctx) -> DataFrame:
    """Requests whose headers look like no browser's, per client and reason."""
    rows = suspicion(_recent_requests(ctx))
    return rows.where(F.col("reason").isNotNull()).groupBy("client", "reason").agg(F.count("*").alias("request_count"))
