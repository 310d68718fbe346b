"""The composite usage filter: dates, workspaces, subscriptions, resource group, tag."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.context import Ctx
from spendscope.functions.classify import subscription_id


@dataclass(frozen=True)
class UsageFilter:
    start: dt.date | None = None
    end: dt.date | None = None
    workspaces: Sequence[str] = ()
    subscriptions: Sequence[str] = ()
    resource_group: str | None = None
    tag_key: str | None = None
    tag_value: str | None = None


class WorkspaceNotAllowed(ValueError):
    pass


def scope_workspaces(ctx: Ctx, df: DataFrame, requested: Sequence[str] = ()) -> DataFrame:
    """Rows of the requested workspaces, else of all allowed ones; ``*`` in the allowed set is all.

    Asking for a workspace outside the allowed set is an error.
    """
    allowed = ctx.allowed_workspaces
    if allowed is not None and not allowed.where("workspace_id = '*'").isEmpty():
        allowed = None
    if requested:
        if allowed is not None:
            known = allowed.where(F.col("workspace_id").isin(*requested)).distinct().count()
            if known < len(set(requested)):
                raise WorkspaceNotAllowed("workspace outside the allowed set")
        return df.where(F.col("workspace_id").isin(*requested))
    if allowed is not None:
        return df.join(allowed.select("workspace_id").distinct(), "workspace_id", "left_semi")
    return df


def workspaces_of(ctx: Ctx, subscriptions: Sequence[str] = (), resource_group: str | None = None) -> DataFrame:
    """Workspace ids of the given subscriptions (ids or display names) and resource group, ignoring case."""
    dim = ctx.table("access.workspaces_latest")
    if subscriptions:
        ids = [subscription_id(s, ctx.subscription_names).lower() for s in subscriptions]
        dim = dim.where(F.lower("subscription_id").isin(*ids))
    if resource_group:
        dim = dim.where(F.lower("resource_group") == resource_group.strip().lower())
    return dim.select("workspace_id").distinct()


def filter_usage(ctx: Ctx, p: UsageFilter, df: DataFrame | None = None) -> DataFrame:
    """Usage rows meeting all given conditions; a scope that resolves to no workspace gives no rows."""
    df = ctx.table("billing.usage") if df is None else df
    start, end = p.start or ctx.back(30), p.end or ctx.day()
    df = df.where((F.col("usage_date") >= F.lit(start)) & (F.col("usage_date") <= F.lit(end)))
    df = scope_workspaces(ctx, df, p.workspaces)
    if p.subscriptions or p.resource_group:
        df = df.join(workspaces_of(ctx, p.subscriptions, p.resource_group), "workspace_id", "left_semi")
    if p.tag_key:
        tag = F.col("custom_tags")[p.tag_key]
        df = df.where(tag == p.tag_value if p.tag_value else tag.isNotNull())
    return df
