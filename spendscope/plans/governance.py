"""Identity and permission changes from audit logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendscope.context import Ctx
from spendscope.functions import classify as C
from spendscope.functions.documents import field, is_broken, parsed
from spendscope.functions.measures import desc, top
from spendscope.plans.registry import report

AUDIT = "access.audit"
LOOKBACK = 30
# Request parameters by column: where they stand in the JSON, and their kind.
GROUP_PARAMS = {"group_name": ("$.groupName", "string"), "principal_id": ("$.principal.id", "bigint"), "principal_kind": ("$.principal.kind", "string")}
PERMISSION_PARAMS = {"object": ("$.changes[0].object", "string"), "level": ("$.changes[0].level", "string"), "principal_id": ("$.principal.id", "bigint")}


def _events(ctx: Ctx) -> DataFrame:
    return ctx.recent_ts(AUDIT, "event_time", LOOKBACK, "event_date").select(
        "event_id", "event_time", "workspace_id", "service_name", "action_name",
        F.coalesce("user_identity.email", F.lit("")).alias("actor"),
    )


def _latest(df: DataFrame, n: int | None) -> DataFrame:
    return top(df, n, desc("event_time"))


def _of(ctx: Ctx, actions: Sequence[str]) -> DataFrame:
    return _events(ctx).where(F.col("action_name").isin(*actions)).drop("service_name")


def _with_params(ctx: Ctx, actions: Sequence[str], params: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Events with fields of their request parameters; ``params_broken`` where these are there but no JSON."""
    given = ctx.recent_ts(AUDIT, "event_time", LOOKBACK, "event_date").where(F.col("action_name").isin(*actions))
    request = parsed("request_params")
    return given.select(
        "event_id", "event_time", "workspace_id", "action_name", F.coalesce("user_identity.email", F.lit("")).alias("actor"),
        *(field(request, path, kind).alias(name) for name, (path, kind) in params.items()), is_broken("request_params").alias("params_broken"),
    )


def _iam(ctx: Ctx) -> DataFrame:
    return _events(ctx).where(C.is_iam_event())


@report("iam_events")
def iam_events(ctx: Ctx, n: int | None = None) -> DataFrame:
    """All events of the window, or the latest ``n``."""
    return _latest(_iam(ctx), n)


@report("sp_events")
def sp_events(ctx: Ctx, n: int | None = None) -> DataFrame:
    return _latest(_of(ctx, C.SP_ACTIONS), n)


@report("token_events")
def token_events(ctx: Ctx, n: int | None = None) -> DataFrame:
    return _latest(_of(ctx, C.TOKEN_ACTIONS), n)


@report("group_events")
def group_events(ctx: Ctx, n: int | None = None) -> DataFrame:
    return _latest(_with_params(ctx, C.GROUP_ACTIONS, GROUP_PARAMS), n)


@report("permission_events")
def permission_events(ctx: Ctx, n: int | None = None) -> DataFrame:
    return _latest(_with_params(ctx, C.PERMISSION_ACTIONS, PERMISSION_PARAMS), n)


@report("token_summary")
def token_summary(ctx: Ctx) -> DataFrame:
    created = F.contains(F.lower("action_name"), F.lit("create"))
    return _of(ctx, C.TOKEN_ACTIONS).agg(F.count_if(created).alias("creates"), F.count_if(~created).alias("deletes"))


@report("group_summary")
def group_summary(ctx: Ctx) -> DataFrame:
    """Adds and creates against everything else, updates included."""
    name = F.lower("action_name")
    added = F.contains(name, F.lit("add")) | F.contains(name, F.lit("create"))
    return _of(ctx, C.GROUP_ACTIONS).agg(F.count_if(added).alias("adds"), F.count_if(~added).alias("removes"))


@report("iam_top_actions")
def iam_top_actions(ctx: Ctx, n: int | None = 20) -> DataFrame:
    return top(_iam(ctx).groupBy("action_name").agg(F.count("*").alias("event_count")), n, desc("event_count"))


@report("iam_top_actors")
def iam_top_actors(ctx: Ctx, n: int | None = 20) -> DataFrame:
    actor = F.coalesce(F.nullif("actor", F.lit("")), F.lit("unknown")).alias("actor")
    return top(_iam(ctx).groupBy(actor).agg(F.count("*").alias("event_count")), n, desc("event_count"))


@report("iam_daily")
def iam_daily(ctx: Ctx) -> DataFrame:
    return _iam(ctx).groupBy(F.to_date("event_time").alias("day")).agg(F.count("*").alias("event_count")).orderBy("day")


@report("governance_summary")
def governance_summary(ctx: Ctx) -> DataFrame:
    n = F.count("*").alias("n")
    actor = F.coalesce(F.nullif("actor", F.lit("")), F.lit("unknown"))
    action, iam = F.col("action_name"), C.is_iam_event()
    # Every listed action is also an IAM event, so one pass counted by actor and action serves them all.
    cells = _events(ctx).where(iam).groupBy(actor.alias("actor"), "action_name").agg(F.count("*").alias("_n"))

    def events_of(actions) -> Column:
        return F.coalesce(F.sum(F.when(action.isin(*actions), F.col("_n"))), F.lit(0))

    return cells.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_iam_events"), F.count_distinct("actor").alias("unique_actors"),
        F.count_distinct("action_name").alias("unique_actions"), events_of(C.TOKEN_ACTIONS).alias("token_events"),
        events_of(C.GROUP_ACTIONS).alias("group_events"), events_of(C.PERMISSION_ACTIONS).alias("permission_events"),
        events_of(C.SP_ACTIONS).alias("sp_count"),
    ).withColumn("group_count", ctx.table("directory.groups").agg(n).scalar())
