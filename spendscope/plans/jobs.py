"""Job and pipeline runs of production workspaces: outcomes, durations, inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendscope.context import Ctx
from spendscope.functions import classify as C
from spendscope.functions.measures import desc, minutes_between, rnd, share_pct, top
from spendscope.operators.versions import latest_version
from spendscope.plans.executive import JOB_FAILED, PIPELINE_FAILED, production_runs
from spendscope.plans.registry import report

LOOKBACK = 30


def prod_only(ctx: Ctx, df: DataFrame) -> DataFrame:
    """Rows of workspaces whose name says production, with that name."""
    prod = ctx.table("access.workspaces_latest").where(C.is_prod_name(F.col("workspace_name")))
    return df.join(prod.select("workspace_id", "workspace_name"), "workspace_id")


def _runs(ctx: Ctx, table: str) -> DataFrame:
    return prod_only(ctx, ctx.recent_ts(table, "period_start_time", LOOKBACK))


def _job_runs(ctx: Ctx) -> DataFrame:
    return _runs(ctx, "lakeflow.job_run_timeline").where(F.col("result_state").isNotNull())


def _pipeline_runs(ctx: Ctx) -> DataFrame:
    return _runs(ctx, "lakeflow.pipeline_update_timeline").where(
        F.col("period_end_time").isNotNull() & F.col("result_state").isNotNull()
    )


def _minutes() -> Column:
    return minutes_between("period_start_time", "period_end_time")


def _outcomes(ok: str, bad: tuple[str, ...]) -> list[Column]:
    state = F.col("result_state")
    return [F.count_if(state == ok).alias("success_count"), F.count_if(state.isin(*bad)).alias("failed_count")]


def _job_stats(ctx: Ctx) -> DataFrame:
    done = F.when(F.col("result_state") == "SUCCEEDED", _minutes())
    return _job_runs(ctx).groupBy("job_id", "workspace_id", "workspace_name", "run_type").agg(
        F.count("*").alias("total_runs"), *_outcomes("SUCCEEDED", JOB_FAILED),
        rnd(F.avg(done), 1).alias("avg_duration_min"), rnd(F.max(done), 1).alias("max_duration_min"),
        F.max("period_end_time").alias("last_run_at"),
        F.max_by("result_state", F.struct("period_end_time", "run_id")).alias("last_result"),
    )


@report("job_runs")
def job_runs(ctx: Ctx, n: int | None = None) -> DataFrame:
    """Top 500 by failures; ``last_result`` is the state of the run that ended last."""
    return top(_job_stats(ctx), n, desc("failed_count"), desc("total_runs"))


@report("join_prod_inner")
def join_prod_inner(ctx: Ctx) -> DataFrame:
    return _job_runs(ctx).groupBy("workspace_id", "workspace_name").agg(F.count("*").alias("runs"))


@report("job_daily")
def job_daily(ctx: Ctx) -> DataFrame:
    return _job_runs(ctx).groupBy(F.to_date("period_start_time").alias("day")).agg(
        F.count("*").alias("total_runs"), *_outcomes("SUCCEEDED", JOB_FAILED)
    ).orderBy("day")


@report("jobs_inventory")
def jobs_inventory(ctx: Ctx) -> DataFrame:
    return _jobs_inventory(ctx).orderBy("workspace_id", "job_id")


def _jobs_inventory(ctx: Ctx) -> DataFrame:
    latest = latest_version(ctx.table("lakeflow.jobs"), ["workspace_id", "job_id"])
    return prod_only(ctx, latest).select(
        "workspace_id", "job_id", F.col("name").alias("job_name"), F.col("creator_user_name").alias("creator"),
        F.col("run_as_user_name").alias("run_as"), F.col("created_time").alias("created_at"),
        F.col("schedule.quartz_cron_expression").alias("cron_schedule"), F.col("schedule.pause_status").alias("schedule_status"),
    )


def _job_names(ctx: Ctx) -> DataFrame:
    return _jobs_inventory(ctx).select("workspace_id", "job_id", "job_name")


@report("top_failures")
def top_failures(ctx: Ctx, n: int | None = 50) -> DataFrame:
    """The 50 latest failures."""
    rows = _runs(ctx, "lakeflow.job_run_timeline").where(F.col("result_state").isin(*JOB_FAILED)).select(
        "run_id", "job_id", "workspace_id", "workspace_name", "result_state",
        F.col("period_start_time").alias("started_at"), rnd(_minutes(), 1).alias("duration_min"),
    )
    return top(rows, n, desc("started_at"))


@report("join_job_inventory")
def join_job_inventory(ctx: Ctx) -> DataFrame:
    """Latest failures with the job's name where it is still in the inventory."""
    named = top_failures(ctx).join(_job_names(ctx), ["workspace_id", "job_id"], "left")
    return named.withColumn("job_name", F.coalesce("job_name", F.lit("")))


@report("pipeline_runs")
def pipeline_runs(ctx: Ctx, n: int | None = None) -> DataFrame:
    done = F.when(F.col("result_state") == "COMPLETED", _minutes())
    rows = _pipeline_runs(ctx).groupBy("pipeline_id", "workspace_id", "workspace_name").agg(
        F.count_distinct("update_id").alias("total_runs"), *_outcomes("COMPLETED", PIPELINE_FAILED),
        rnd(F.avg(done), 1).alias("avg_duration_min"), F.max("period_end_time").alias("last_run_at"),
    )
    best = top(rows, n, desc("failed_count"))
    named = best.join(_pipelines_inventory(ctx).select("workspace_id", "pipeline_id", "pipeline_name"), ["workspace_id", "pipeline_id"], "left")
    return named.withColumn("success_rate", share_pct("success_count", "total_runs"))


@report("combined_sla")
def combined_sla(ctx: Ctx) -> DataFrame:
    """Jobs and pipelines together, over 7 and 30 days in one pass."""
    week = F.to_date("period_start_time") >= F.lit(ctx.back(7))
    by_kind = production_runs(ctx, 30).groupBy("kind").agg(
        F.count_distinct(F.when(week, F.col("run_id"))).alias("runs_7d"), F.count_distinct("run_id").alias("runs_30d"),
        F.count_if(week & F.col("succeeded")).alias("ok_7d"), F.count_if("succeeded").alias("ok_30d"),
        F.count_if(week & F.col("failed")).alias("bad_7d"), F.count_if("failed").alias("bad_30d"),
    )

    def total(c: str, kind: str | None = None) -> Column:
        value = F.when(F.col("kind") == kind, F.col(c)) if kind else F.col(c)
        return F.coalesce(F.sum(value), F.lit(0))

    sums = by_kind.agg(*[
        x for d in ("7d", "30d") for x in (
            total(f"runs_{d}").alias(f"total_runs_{d}"), total(f"ok_{d}").alias(f"succeeded_{d}"),
            total(f"bad_{d}").alias(f"failed_{d}"), total(f"runs_{d}", "job").alias(f"job_runs_{d}"),
            total(f"runs_{d}", "pipeline").alias(f"pipeline_runs_{d}"),
        )
    ])
    return sums.withColumns({f"sla_pct_{d}": share_pct(f"succeeded_{d}", f"total_runs_{d}") for d in ("7d", "30d")})


@report("job_task_counts")
def job_task_counts(ctx: Ctx) -> DataFrame:
    """Distinct live tasks per job and workspace."""
    live = latest_version(ctx.table("lakeflow.job_tasks"), ["workspace_id", "job_id", "task_key"])
    return prod_only(ctx, live).groupBy("workspace_id", "job_id").agg(F.count("*").alias("task_count"))


def _task_runs(ctx: Ctx) -> DataFrame:
    return _runs(ctx, "lakeflow.job_task_run_timeline").where(F.col("period_end_time").isNotNull())


@report("task_bottlenecks")
def task_bottlenecks(ctx: Ctx, n: int | None = None) -> DataFrame:
    rows = _task_runs(ctx).groupBy(
        "job_id", "task_key", "workspace_id", "workspace_name"
    ).agg(
        F.count("*").alias("run_count"), *_outcomes("SUCCEEDED", JOB_FAILED),
        rnd(F.avg(_minutes()), 1).alias("avg_duration_min"), rnd(F.max(_minutes()), 1).alias("max_duration_min"),
    )
    best = top(rows, n, desc("avg_duration_min"))
    return best.join(_job_names(ctx), ["workspace_id", "job_id"], "left")


def _pipelines_inventory(ctx: Ctx) -> DataFrame:
    latest = latest_version(ctx.table("lakeflow.pipelines"), ["workspace_id", "pipeline_id"])
    return prod_only(ctx, latest).select(
        "workspace_id", "pipeline_id", F.col("name").alias("pipeline_name"), "workspace_name",
        F.col("creator_user_name").alias("creator"), F.col("run_as_user_name").alias("run_as"), "channel", "edition",
        F.col("created_time").alias("created_at"),
    )


@report("pipelines_inventory")
def pipelines_inventory(ctx: Ctx) -> DataFrame:
    return _pipelines_inventory(ctx).orderBy("workspace_id", "pipeline_id")


@report("pipeline_updates")
def pipeline_updates(ctx: Ctx, n: int | None = None) -> DataFrame:
    rows = _pipeline_runs(ctx).select(
        "update_id", "pipeline_id", "workspace_id", "workspace_name", F.col("result_state").alias("state"),
        rnd(_minutes(), 1).alias("duration_min"), F.col("period_start_time").alias("started_at"),
        F.col("period_end_time").alias("ended_at"),
    )
    names = _pipelines_inventory(ctx).select("workspace_id", "pipeline_id", "pipeline_name")
    return top(rows, n, desc("started_at")).join(names, ["workspace_id", "pipeline_id"], "left")


@report("job_report")
def job_report(ctx: Ctx) -> DataFrame:
    """Job run statistics with inventory, task count and success rate."""
    rows = job_runs(ctx).join(_jobs_inventory(ctx), ["workspace_id", "job_id"], "left")
    rows = rows.join(job_task_counts(ctx), ["workspace_id", "job_id"], "left")
    return rows.withColumns({
        "task_count": F.coalesce("task_count", F.lit(0)), "success_rate": share_pct("success_count", "total_runs"),
    })


@report("job_report_summary")
def job_report_summary(ctx: Ctx) -> DataFrame:
    """Totals over all jobs, pipelines and tasks of the window, beyond the listed top ones."""
    n = F.count("*").alias("n")
    sums = _job_stats(ctx).agg(
        F.count("*").alias("total_jobs"), *[
            F.coalesce(F.sum(c), F.lit(0)).alias(a)
            for c, a in (("total_runs", "total_runs"), ("success_count", "total_success"), ("failed_count", "total_failed"))
        ]
    )
    return sums.withColumns({
        "sla_pct": share_pct("total_success", "total_runs"), "pipelines": _pipeline_runs(ctx).select("pipeline_id", "workspace_id").distinct().agg(n).scalar(),
        "task_bottlenecks": _task_runs(ctx).select("job_id", "task_key", "workspace_id").distinct().agg(n).scalar(),
        "pipeline_inventory": _pipelines_inventory(ctx).agg(n).scalar(),
    })
