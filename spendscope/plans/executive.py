"""Executive scorecard: spend KPIs, run rate, forecasts, concentration, reliability, savings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendscope.context import Ctx
from spendscope.functions import classify as C
from spendscope.functions.measures import (
    change_pct, desc, hours_between, minutes_between, rnd, share_pct, top, total, total_if,
)
from spendscope.operators.pricing import priced_usage
from spendscope.operators.smoothing import forecast_sums
from spendscope.operators.versions import latest_version
from spendscope.plans.cost import with_workspace
from spendscope.plans.registry import report

JOB_FAILED = ("FAILED", "CANCELLED", "TIMED_OUT", "ERROR")
PIPELINE_FAILED = ("FAILED", "CANCELED")
VENDOR_DOMAIN = "vendor.example"
CONTRACT_MONTH = 8


def _since(ctx: Ctx, days: int) -> Column:
    return F.col("usage_date") >= F.lit(ctx.back(days))


def daily_cost(ctx: Ctx, days: int) -> DataFrame:
    """One row per day with usage, at most ``days`` + 1 rows."""
    return priced_usage(ctx, days).groupBy("usage_date").agg(
        total("cost").alias("cost"), total("usage_quantity").alias("units")
    )


@report("spend_scorecard")
def spend_scorecard(ctx: Ctx) -> DataFrame:
    recent, month = _since(ctx, 30), F.col("usage_date") >= F.lit(ctx.day().replace(day=1))
    sum14 = F.coalesce(F.sum(F.when(_since(ctx, 14), F.col("cost"))), F.lit(0)).cast("double")
    return priced_usage(ctx, 60).agg(
        total_if(recent, "cost").alias("cost_30d"),
        total_if(~recent, "cost").alias("cost_prev_30d"),
        rnd(sum14 / 14, 4).alias("avg_daily_14d"),
        total_if(month, "cost").alias("month_to_date"),
        total_if(recent, "usage_quantity").alias("units_30d"),
        F.count_distinct(F.when(recent, F.col("workspace_id"))).alias("workspace_count"),
    ).withColumn("mom_delta_pct", change_pct("cost_30d", "cost_prev_30d"))


@report("month_end_projection")
def month_end_projection(ctx: Ctx) -> DataFrame:
    """Month to date plus the remaining days: by the linear trend of the last 30 days, floored at 0
    per day, or by the 14-day average when there are fewer than seven days of data."""
    today = ctx.day()
    month_end = (today.replace(day=28) + dt.timedelta(days=4)).replace(day=1) - dt.timedelta(days=1)
    left = (month_end - today).days
    offset = F.date_diff("usage_date", F.lit(ctx.back(30))).cast("double")
    in_month = F.col("usage_date") >= F.lit(today.replace(day=1))
    fit = daily_cost(ctx, 30).agg(
        F.count("*").alias("days_of_data"),
        rnd(F.coalesce(F.sum(F.when(in_month, F.col("cost"))), F.lit(0.0)), 2).alias("month_to_date"),
        (F.coalesce(F.sum(F.when(_since(ctx, 14), F.col("cost"))), F.lit(0.0)) / 14).alias("_avg"),
        F.regr_slope("cost", offset).alias("_slope"),
        F.regr_intercept("cost", offset).alias("_base"),
    )
    ahead = F.sequence(F.lit(1), F.lit(left)) if left else F.array().cast("array<int>")
    trend = F.aggregate(
        ahead, F.lit(0.0),
        lambda acc, i: acc + F.greatest(F.lit(0.0), F.col("_base") + F.col("_slope") * (F.lit(30) + i)),
    )
    by_trend = (F.col("days_of_data") >= 7) & F.col("_slope").isNotNull()
    rest = F.when(by_trend, trend).otherwise(F.col("_avg") * left)
    return fit.select(
        "days_of_data", "month_to_date", F.lit(left).alias("days_remaining"),
        rnd(rest, 2).alias("forecast_remaining"),
        rnd(F.col("month_to_date") + rest, 2).alias("projected_month_end"),
        F.when(by_trend, "trend").otherwise("average").alias("method"),
    )


@report("run_rate")
def run_rate(ctx: Ctx) -> DataFrame:
    """Daily spend rate and a forecast rate of 60 % last 14 days, 40 % the days before."""
    d14 = _since(ctx, 14)
    sums = daily_cost(ctx, 30).agg(
        rnd(F.coalesce(F.sum("cost"), F.lit(0.0)), 2).alias("total_usage"),
        rnd(F.coalesce(F.sum(F.when(d14, F.col("cost"))), F.lit(0.0)), 2).alias("_t14"),
        F.count("*").alias("_n30"), F.count_if(d14).alias("_n14"),
        F.coalesce(F.min("usage_date"), F.lit(ctx.back(30))).alias("period_start"),
        F.coalesce(F.max("usage_date"), F.lit(ctx.day())).alias("period_end"),
    )
    # Without any day the divisors are the window lengths.
    sums = sums.withColumn("_n30", F.when(F.col("_n30") > 0, F.col("_n30")).otherwise(30)).withColumn(
        "_n14", F.when(F.col("_n14") > 0, F.col("_n14")).otherwise(14)
    )
    n_before = F.col("_n30") - F.col("_n14")
    sums = sums.withColumn("run_rate_per_day", rnd(F.col("total_usage") / F.col("_n30"), 2))
    before = F.when(n_before > 0, F.try_divide(F.col("total_usage") - F.col("_t14"), n_before)).otherwise(
        F.col("run_rate_per_day")
    )
    sums = sums.withColumn("forecasted_run_rate", rnd(F.col("_t14") / F.col("_n14") * 0.6 + before * 0.4, 2))
    return sums.select(
        "total_usage", "period_start", "period_end", "run_rate_per_day", "forecasted_run_rate",
        change_pct("forecasted_run_rate", "run_rate_per_day").alias("forecast_pct_change"),
        rnd(F.col("forecasted_run_rate") * 30, 2).alias("forecasted_usage"),
        F.lit(ctx.day() + dt.timedelta(days=1)).alias("forecast_start"),
        F.lit(ctx.day() + dt.timedelta(days=30)).alias("forecast_end"),
    )


@report("exec_cost_trend")
def exec_cost_trend(ctx: Ctx) -> DataFrame:
    return daily_cost(ctx, 30).orderBy("usage_date")


def _workspace_totals(ctx: Ctx) -> DataFrame:
    by_ws = priced_usage(ctx, 30).groupBy("workspace_id").agg(
        total("cost").alias("cost"), total("usage_quantity").alias("units")
    )
    return with_workspace(ctx, by_ws, "workspace_name").withColumn(
        "workspace_name", F.coalesce("workspace_name", "workspace_id")
    )


@report("top_workspaces")
def top_workspaces(ctx: Ctx, n: int | None = 8) -> DataFrame:
    return top(_workspace_totals(ctx), n, desc("cost"))


@report("join_workspace_dim")
def join_workspace_dim(ctx: Ctx) -> DataFrame:
    return _workspace_totals(ctx)


@report("top_products")
def top_products(ctx: Ctx) -> DataFrame:
    """Grouped by the raw origin code, so two codes may share a label."""
    rows = priced_usage(ctx, 30).groupBy("billing_origin_product").agg(
        total("cost").alias("cost"), total("usage_quantity").alias("units")
    )
    label = C.origin_product_label(F.col("billing_origin_product"))
    return rows.select(label.alias("product_category"), "cost", "units").orderBy(desc("cost"))


@report("forecast_7d")
def forecast_7d(ctx: Ctx, method: str = "mean") -> DataFrame:
    """Next seven days from the slope of the last seven daily totals; no rows with less history.

    ``mean`` starts from the mean of those days, ``ols`` continues the fitted line.
    """
    newest = Window.orderBy(desc("usage_date"))  # over at most 31 daily rows
    days = daily_cost(ctx, 30).withColumn("_rn", F.row_number().over(newest))
    last7, x = F.col("_rn") <= 7, (F.lit(7) - F.col("_rn")).cast("double")
    y7 = F.when(last7, F.col("cost"))
    fit = days.agg(
        F.count("*").alias("_n"), F.avg("cost").alias("_mean30"), F.avg(y7).alias("_mean7"),
        F.regr_slope(y7, F.when(last7, x)).alias("_slope"),
        F.max_by("cost", "usage_date").alias("last_actual_cost"),
    ).where(F.col("_n") >= 7)
    start = F.col("_mean7") + (F.lit(3.0) * F.col("_slope") if method == "ols" else F.lit(0.0))
    values = F.transform(
        F.sequence(F.lit(1), F.lit(7)), lambda i: rnd(F.greatest(F.lit(0.0), start + F.col("_slope") * i), 2)
    )
    mean = F.aggregate("_values", F.lit(0.0), lambda acc, v: acc + v) / 7
    return (
        fit.withColumn("_values", values)
        .withColumn("avg_forecast_daily", mean)
        .select(
            F.posexplode("_values").alias("_i", "cost"), "avg_forecast_daily", "_mean30", "last_actual_cost"
        )
        .select(
            F.date_add(F.lit(ctx.day()), F.col("_i") + 1).alias("forecast_date"), "cost",
            rnd("avg_forecast_daily", 2).alias("avg_forecast_daily"),
            change_pct("avg_forecast_daily", "_mean30").alias("forecast_pct_change"), "last_actual_cost",
        )
    )


@report("pareto_top")
def pareto_top(ctx: Ctx, n: int | None = 10) -> DataFrame:
    """The ten costliest workspaces with their rank."""
    ten = top(_workspace_totals(ctx).select("workspace_id", "workspace_name", "cost"), n, desc("cost"))
    order = Window.orderBy(desc("cost"), "workspace_id")  # over n rows, ten unless asked otherwise
    return ten.withColumn("rank", F.row_number().over(order))


@report("pareto")
def pareto(ctx: Ctx) -> DataFrame:
    whole = _workspace_totals(ctx).select(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("c")).scalar()
    shares = pareto_top(ctx).agg(
        F.sum(F.when(F.col("rank") <= 5, F.col("cost"))).alias("_c5"), F.sum("cost").alias("_c10")
    ).withColumn("_all", whole)
    top10 = share_pct("_c10", "_all")
    return shares.select(
        share_pct("_c5", "_all").alias("top_5_pct"), top10.alias("top_10_pct"),
        rnd(F.lit(100.0) - top10, 1).alias("long_tail_pct"), rnd("_all", 2).alias("total_cost"),
    )


# ---- job and pipeline reliability ----


def production_runs(ctx: Ctx, days: int) -> DataFrame:
    """Finished job runs and pipeline updates of production workspaces, for jobs and pipelines that
    still exist: kind, run_id, period times, succeeded, failed."""
    prod = ctx.table("access.workspaces_latest").where(C.is_prod_name(F.col("workspace_name"))).select("workspace_id")

    def runs(kind, table, dim, key, run, ok, bad):
        alive = latest_version(ctx.table(dim), ["workspace_id", key]).select("workspace_id", key)
        state = F.col("result_state")
        return (
            ctx.recent_ts(table, "period_start_time", days).where(state.isNotNull())
            .join(alive, ["workspace_id", key], "left_semi").join(prod, "workspace_id", "left_semi")
            .select(F.lit(kind).alias("kind"), F.col(run).alias("run_id"), "period_start_time", "period_end_time",
                    (state == ok).alias("succeeded"), state.isin(*bad).alias("failed"))
        )

    return runs(
        "job", "lakeflow.job_run_timeline", "lakeflow.jobs", "job_id", "run_id", "SUCCEEDED", JOB_FAILED
    ).unionByName(runs(
        "pipeline", "lakeflow.pipeline_update_timeline", "lakeflow.pipelines", "pipeline_id", "update_id",
        "COMPLETED", PIPELINE_FAILED,
    ))


@report("job_health")
def job_health(ctx: Ctx) -> DataFrame:
    """Distinct runs against row counts of outcomes; ``avg_duration_mins`` is the mean of the two
    kinds' means, ``weighted_duration_mins`` the mean over all successes."""
    ok, mins = F.col("succeeded"), minutes_between("period_start_time", "period_end_time")
    by_kind = production_runs(ctx, 30).groupBy("kind").agg(
        F.count_distinct("run_id").alias("runs"), F.count_if(ok).alias("ok"), F.count_if("failed").alias("bad"),
        rnd(F.avg(F.when(ok, mins)), 1).alias("mean"),
        F.sum(F.when(ok, mins)).alias("mins"),
    )

    def of(kind, c):
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(c))), F.lit(0))

    both = by_kind.agg(
        of("job", "runs").alias("job_runs_30d"), of("pipeline", "runs").alias("pipeline_runs_30d"),
        F.coalesce(F.sum("runs"), F.lit(0)).alias("total_runs_30d"),
        F.coalesce(F.sum("ok"), F.lit(0)).alias("succeeded_30d"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("failed_30d"),
        rnd((of("job", "mean") + of("pipeline", "mean")) / 2, 1).alias("avg_duration_mins"),
        F.sum("mins").alias("_mins"),
    )
    return both.select(
        "job_runs_30d", "pipeline_runs_30d", "total_runs_30d", "succeeded_30d", "failed_30d", "avg_duration_mins",
        share_pct("succeeded_30d", "total_runs_30d").alias("success_rate_pct"),
        rnd(F.try_divide(F.col("_mins").cast("double"), F.col("succeeded_30d")), 1).alias("weighted_duration_mins"),
    )


@report("join_using_latest")
def join_using_latest(ctx: Ctx) -> DataFrame:
    """Runs per kind and outcome after joining the latest version of their job or pipeline."""
    return production_runs(ctx, 30).groupBy("kind", "succeeded", "failed").agg(F.count("*").alias("row_count"))


@report("active_users")
def active_users(ctx: Ctx, vendor_domain: str = VENDOR_DOMAIN) -> DataFrame:
    email = F.col("user_identity.email")
    week = F.col("event_date") >= F.lit(ctx.back(7, "access.audit"))
    humans = ctx.recent("access.audit", "event_date", 30).where(C.is_human(email, vendor_domain))
    pairs = humans.groupBy(email.alias("email"), "service_name").agg(F.max(week).alias("_week"))
    return pairs.agg(
        F.count_distinct("email").alias("active_users_30d"),
        F.count_distinct(F.when(F.col("_week"), F.col("email"))).alias("active_users_7d"),
        F.count_distinct("service_name").alias("services_used_30d"),
    )


# ---- savings ----


def _opportunity(df: DataFrame, category: str, basis: Column, rate: float, count: Column, priority: Column) -> DataFrame:
    """One row category / resource_count / basis / estimated_saving / priority, none without resources."""
    row = df.agg(count.alias("resource_count"), F.coalesce(basis, F.lit(0.0)).alias("basis"))
    row = row.withColumn("estimated_saving", rnd(F.col("basis") * rate, 2)).where(F.col("resource_count") > 0)
    return row.select(
        F.lit(category).alias("category"), "resource_count", rnd("basis", 2).alias("basis"), "estimated_saving",
        priority.alias("priority"),
    )


# The names that identify the kinds of saving.
INTERACTIVE, WAREHOUSES, FAILED_JOBS = "Interactive compute waste", "SQL Warehouse right-sizing", "Failed long-running jobs"


@report("savings_interactive")
def savings_interactive(ctx: Ctx) -> DataFrame:
    """40 % of the all-purpose clusters that ran no job in the last week."""
    meta = F.col("usage_metadata")
    rows = (
        priced_usage(ctx, 7)
        .where(F.col("sku_name").contains("ALL_PURPOSE") & meta["cluster_id"].isNotNull() & meta["job_run_id"].isNull())
        .groupBy(meta["cluster_id"].alias("cluster_id")).agg(total("cost").alias("cost")).where("cost > 20")
    )
    critical = F.when(F.col("estimated_saving") > 500, "critical").otherwise("warning")
    return _opportunity(
        rows, INTERACTIVE, F.sum("cost"), 0.4, F.count("*"), critical
    )


@report("savings_warehouse")
def savings_warehouse(ctx: Ctx) -> DataFrame:
    """25 % of the SQL warehouses in steady use."""
    wh = F.col("usage_metadata.warehouse_id")
    rows = (
        priced_usage(ctx, 30).where(F.col("sku_name").contains("SQL") & wh.isNotNull())
        .groupBy(wh.alias("warehouse_id"))
        .agg(total("cost").alias("cost"), F.count_distinct("usage_date").alias("active_days"))
        .where("active_days >= 5 AND cost > 50")
    )
    return _opportunity(
        rows, WAREHOUSES, F.sum("cost"), 0.25, F.count("*"), F.lit("warning")
    )


@report("savings_failed_jobs")
def savings_failed_jobs(ctx: Ctx) -> DataFrame:
    """Hours of runs that failed or timed out after more than an hour; both timeout spellings count."""
    hours = hours_between("period_start_time", "period_end_time")
    rows = ctx.recent_ts("lakeflow.job_run_timeline", "period_start_time", 7).where(
        F.col("result_state").isin("FAILED", "TIMEDOUT", "TIMED_OUT") & (hours > 1)
    )
    return _opportunity(
        rows, FAILED_JOBS, rnd(F.sum(hours), 1), 0.0, F.count("*"), F.lit("info")
    )


@report("savings_compute")
def savings_compute(ctx: Ctx) -> DataFrame:
    """30 % of last week's premium compute; ``_`` in the pattern is a wildcard."""
    meta = F.col("usage_metadata")
    rows = priced_usage(ctx, 7).where(F.col("sku_name").like("PREMIUM_%COMPUTE%"))
    resource = F.coalesce(meta["warehouse_id"], meta["cluster_id"], F.col("sku_name"))
    out = _opportunity(
        rows, "Anomalous compute spend", total("cost"), 0.3, F.count_distinct(resource), F.lit("warning")
    )
    return out.where("basis > 0")


@report("savings_opportunities")
def savings_opportunities(ctx: Ctx) -> DataFrame:
    rows = (
        savings_interactive(ctx).unionByName(savings_warehouse(ctx)).unionByName(savings_failed_jobs(ctx))
        .unionByName(savings_compute(ctx))
    )
    whole = Window.partitionBy(F.lit(1))  # at most four rows
    return rows.withColumn("total_saving", rnd(F.sum("estimated_saving").over(whole), 2)).orderBy(
        desc("estimated_saving")
    )


def _month_end(day: dt.date) -> dt.date:
    return (day.replace(day=28) + dt.timedelta(days=4)).replace(day=1) - dt.timedelta(days=1)


def _series(costs: DataFrame, *keys: str | Column) -> DataFrame:
    """Costs per product category and of all together, as series."""
    cells = costs.groupBy(C.product_category(F.col("sku_name")).alias("category"), *keys).agg(F.sum("cost").alias("cost"))
    names = F.explode(F.array(F.lit("all"), F.col("category"))).alias("series")
    by = [c for c in cells.columns if c not in ("category", "cost")]
    return cells.select("*", names).groupBy("series", *by).agg(total("cost").alias("cost"))


@report("month_end_smoothed")
def month_end_smoothed(ctx: Ctx, history_days: int = 90) -> DataFrame:
    """Month to date plus the remaining days by smoothing with a weekly season, with 95 % bounds, in total and per product.

    Series of less than fifteen days go on with the mean of the last fourteen days, without bounds.
    """
    today = ctx.day()
    left = (_month_end(today) - today).days
    day = F.col("usage_date")
    daily = _series(priced_usage(ctx, history_days), "usage_date")
    last_day = daily.select("series").distinct().select("series", F.lit(history_days).alias("period"), F.lit(0.0).alias("value"))  # today counts, also without cost
    periods = daily.select("series", F.date_diff(day, F.lit(ctx.back(history_days))).alias("period"), F.col("cost").alias("value")).unionByName(last_day)
    sums = daily.groupBy("series").agg(
        rnd(F.coalesce(F.sum(F.when(day >= F.lit(today.replace(day=1)), F.col("cost"))), F.lit(0.0)), 2).alias("month_to_date"),
        (F.coalesce(F.sum(F.when(day > F.lit(ctx.back(14)), F.col("cost"))), F.lit(0.0)) / 14 * left).alias("_average"),
    )
    rest, low, high = (c if left else F.lit(0.0) for c in (F.coalesce("forecast", "_average"), F.col("low"), F.col("high")))
    return sums.join(forecast_sums(periods, 7, 1, max(left, 1)), "series").select(
        "series", F.col("periods").alias("days_of_data"), "month_to_date", F.lit(left).alias("days_remaining"), rnd(rest, 2).alias("forecast_remaining"),
        rnd(F.col("month_to_date") + rest, 2).alias("projected_month_end"), rnd(F.col("month_to_date") + low, 2).alias("projected_low"),
        rnd(F.col("month_to_date") + high, 2).alias("projected_high"), F.when(F.col("forecast").isNotNull(), "smoothing").otherwise("average").alias("method"),
    )


# ---- contract-year forecast ----


@report("annual_smoothed")
def annual_smoothed(ctx: Ctx, start_month: int = CONTRACT_MONTH, history_months: int = 60) -> DataFrame:
    """The next contract year by smoothing of full months with a yearly season, with 95 % bounds, in total and per product.

    Series of less than 25 months repeat their mean month, without bounds.
    """
    this_month = ctx.day().replace(day=1)
    begin = dt.date(this_month.year - history_months // 12, this_month.month, 1)
    usage = ctx.table("billing.usage").where((F.col("usage_date") >= F.lit(begin)) & (F.col("usage_date") < F.lit(this_month)))
    monthly = _series(priced_usage(ctx, usage=usage), F.trunc("usage_date", "month").alias("month"))
    following = contract_year_start(ctx.day(), start_month)
    following = following.replace(year=following.year + 1)
    first = (following.year - this_month.year) * 12 + following.month - this_month.month + 1
    periods = monthly.select("series", F.round(F.months_between("month", F.lit(begin))).cast("int").alias("period"), F.col("cost").alias("value"))
    last_month = monthly.select("series").distinct().select("series", F.lit(history_months // 12 * 12 - 1).alias("period"), F.lit(0.0).alias("value"))
    mean = monthly.groupBy("series").agg(rnd(F.sum("cost"), 2).alias("cost_so_far"))
    found = forecast_sums(periods.unionByName(last_month), 12, first, first + 11).join(mean, "series")
    return found.select(
        "series", F.col("periods").alias("months_of_data"), "cost_so_far", F.lit(following).alias("year_start"),
        rnd(F.coalesce("forecast", F.col("cost_so_far") / F.col("periods") * 12), 2).alias("forecast_cost"), rnd("low", 2).alias("forecast_low"), rnd("high", 2).alias("forecast_high"),
        F.when(F.col("forecast").isNotNull(), "smoothing").otherwise("average").alias("method"),
    )


def contract_year_start(day: dt.date, month: int = CONTRACT_MONTH) -> dt.date:
    return dt.date(day.year if day.month >= month else day.year - 1, month, 1)


@report("annual_forecast")
def annual_forecast(ctx: Ctx, start_month: int = CONTRACT_MONTH) -> DataFrame:
    """Two past contract years, the current one up to the last full month, and the next one.

    The forecast is the linear trend of the monthly totals times a month-of-year index (mean ratio of
    actual to trend), summed over the twelve months of the next contract year. Where that is not
    positive, the last full year grows by its year-on-year rate, kept within -50 % and +200 %.
    """
    today = ctx.day()
    current = contract_year_start(today, start_month)
    year = {k: current.replace(year=current.year + k) for k in (-2, -1, 0, 1, 2)}
    usage = ctx.table("billing.usage").where(
        (F.col("usage_date") >= F.lit(year[-2])) & (F.col("usage_date") < F.lit(today))
    )
    months = (
        priced_usage(ctx, usage=usage).groupBy(F.trunc("usage_date", "month").alias("month"))
        .agg(total("cost").alias("cost"))
        .withColumn("_x", F.round(F.months_between("month", F.lit(year[-2]))).cast("double"))
        .withColumn("_full", F.col("month") < F.lit(today.replace(day=1)))
    )
    every = Window.partitionBy(F.lit(1))  # at most 36 monthly rows
    y, x = F.when(F.col("_full"), F.col("cost")), F.when(F.col("_full"), F.col("_x"))
    months = months.withColumn("_slope", F.regr_slope(y, x).over(every)).withColumn(
        "_base", F.regr_intercept(y, x).over(every)
    )
    months = months.withColumn("_ratio", F.when(
        F.col("_full"), F.try_divide(F.col("cost"), F.col("_base") + F.col("_slope") * F.col("_x"))
    )).withColumn("_season", F.avg("_ratio").over(Window.partitionBy(F.month("month"))))
    # The same calendar month of the next contract year, once per month of year.
    first = F.row_number().over(Window.partitionBy(F.month("month")).orderBy("month")) == 1
    lead = (F.month("month") - start_month + 12) % 12 + 36
    ahead = F.when(first, (F.col("_base") + F.col("_slope") * lead) * F.col("_season"))

    def spent(lo: dt.date, hi: dt.date) -> Column:
        inside = (F.col("month") >= F.lit(lo)) & (F.col("month") < F.lit(hi))
        return rnd(F.coalesce(F.sum(F.when(inside, F.col("cost"))), F.lit(0.0)), 2)

    this_month = today.replace(day=1)
    full = max(0, (this_month.year - current.year) * 12 + this_month.month - current.month)
    sums = months.withColumn("_ahead", ahead).agg(
        spent(year[-2], year[-1]).alias("cy1_cost"), spent(year[-1], year[0]).alias("cy2_cost"),
        spent(year[0], this_month).alias("cy_current_cost"),
        rnd(F.coalesce(F.sum("_ahead"), F.lit(0.0)), 2).alias("_trend"), F.count("*").alias("data_months"),
    )
    c1, c2 = F.col("cy1_cost"), F.col("cy2_cost")
    growth = F.when((c1 > 0) & (c2 > 0), F.greatest(F.lit(-0.5), F.least(F.lit(2.0), F.try_divide(c2 - c1, c1))))
    by_trend = F.coalesce(F.col("_trend") > 0, F.lit(False))

    def label(start: dt.date) -> Column:
        return F.lit(f"{start:%b} {start.year} - {start.replace(month=(start.month - 2) % 12 + 1):%b} {start.year + 1}")

    return sums.select(
        label(year[-2]).alias("cy1_label"), "cy1_cost", label(year[-1]).alias("cy2_label"), "cy2_cost",
        label(year[0]).alias("cy_current_label"), "cy_current_cost", F.lit(full).alias("cy_current_months"),
        label(year[1]).alias("forecast_label"),
        F.when(by_trend, F.col("_trend")).otherwise(rnd(c2 * (1 + F.coalesce(growth, F.lit(0.0))), 2)).alias("forecast_cost"),
        F.when(by_trend, "trend").otherwise("yoy").alias("forecast_method"),
        rnd(c2 * (1 + F.coalesce(growth, F.lit(0.0))), 2).alias("yoy_forecast_cost"),
        rnd(growth * 100, 1).alias("yoy_growth_pct"), "data_months",
    )


# ---- allocation, infrastructure, governance ----


def _by_area(ctx: Ctx, *keys: str | Column) -> DataFrame:
    area = C.tag_alias(C.PRODUCT_AREA_TAGS, default="Untagged").alias("product_area")
    return priced_usage(ctx, 30).groupBy(area, *keys)


@report("product_area_spend")
def product_area_spend(ctx: Ctx) -> DataFrame:
    return _by_area(ctx).agg(total("cost").alias("cost"), total("usage_quantity").alias("units")).orderBy(desc("cost"))


@report("chargeback")
def chargeback(ctx: Ctx) -> DataFrame:
    by_ws = _by_area(ctx, "workspace_id").agg(F.sum("cost").alias("_c"), F.sum("usage_quantity").alias("_u"))
    name = F.coalesce("workspace_name", "workspace_id").alias("workspace_name")
    return (
        with_workspace(ctx, by_ws, "workspace_name").groupBy("product_area", name)
        .agg(total("_c").alias("cost"), total("_u").alias("units")).orderBy("product_area", desc("cost"))
    )


@report("infra_costs")
def infra_costs(ctx: Ctx, n: int | None = None) -> DataFrame:
    code = F.col("billing_origin_product")
    by_ws = (
        priced_usage(ctx, 30).where(C.is_infra(code, F.col("usage_type")))
        .groupBy(C.infra_category(code).alias("infra_category"),
                 F.coalesce("usage_type", F.lit("UNKNOWN")).alias("usage_type"), "workspace_id")
        .agg(F.sum("cost").alias("_c"), F.sum("usage_quantity").alias("_u"))
    )
    name = F.when(F.col("workspace_id").isNull(), "Account-level").otherwise(F.coalesce("workspace_name", "workspace_id"))
    rows = with_workspace(ctx, by_ws, "workspace_name").groupBy(
        "infra_category", "usage_type", name.alias("workspace_name")
    ).agg(total("_u", 4).alias("units"), total("_c", 4).alias("cost"))
    return top(rows, n, desc("cost"))


@report("sla_breaches")
def sla_breaches(ctx: Ctx, n: int | None = 50) -> DataFrame:
    """The 50 latest failed runs of jobs whose latest version is tagged as production."""
    jobs = latest_version(ctx.table("lakeflow.jobs"), ["workspace_id", "job_id"], drop_deleted=False)
    jobs = jobs.where(C.is_prod_tag()).select("workspace_id", "job_id", F.col("name").alias("job_name"))
    rows = (
        ctx.recent_ts("lakeflow.job_run_timeline", "period_start_time", 7)
        .where(F.col("result_state").isin(*JOB_FAILED)).join(jobs, ["workspace_id", "job_id"])
        .select("run_id", "job_name", "workspace_id", "result_state", "termination_code",
                F.col("period_start_time").alias("started_at"), F.col("period_end_time").alias("ended_at"),
                rnd(minutes_between("period_start_time", "period_end_time"), 1).alias("duration_mins"))
    )
    return top(rows, n, desc("started_at"))


@report("governance_signals")
def governance_signals(ctx: Ctx) -> DataFrame:
    action = F.col("action_name")
    return ctx.recent("access.audit", "event_date", 7).agg(
        F.count_if(action == "createToken").alias("new_tokens_7d"),
        F.count_if(action.isin("deleteToken", "revokeToken")).alias("revoked_tokens_7d"),
        F.count_if(action.isin("addGroupMember", "removeGroupMember")).alias("group_changes_7d"),
        F.count_if(action.contains("Permission") | action.contains("Grant")).alias("permission_changes_7d"),
        F.count_distinct("user_identity.email").alias("distinct_actors_7d"),
    )
