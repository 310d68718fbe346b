"""Filters and labels on their own: how usage, resources, runs and principals are classified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendscope.context import Ctx, day_start
from spendscope.functions import classify as C
from spendscope.functions.measures import rnd, total
from spendscope.operators.filters import UsageFilter, filter_usage
from spendscope.plans.cost import ID_FIELDS
from spendscope.plans.executive import VENDOR_DOMAIN
from spendscope.plans.registry import report
from spendscope.sources import permissions


def _units_by_workspace(df: DataFrame) -> DataFrame:
    return df.groupBy("workspace_id").agg(F.count("*").alias("row_count"), total("usage_quantity").alias("units"))


@report("filter_usage")
def filter_usage_all(ctx: Ctx) -> DataFrame:
    """Period, workspaces, subscription and tag value together."""
    p = UsageFilter(
        start=ctx.back(365), workspaces=("ws-0", "ws-4", "ws-8", "ws-12"), subscriptions=("SUB-0",),
        tag_key="Env", tag_value="prod",
    )
    return _units_by_workspace(filter_usage(ctx, p))


@report("scope_workspaces")
def scope_to_allowed(ctx: Ctx) -> DataFrame:
    """Without a request, everything is scoped to the allowed workspaces."""
    allowed = ctx.table("access.workspaces_latest").where(F.col("region") == "EUROPE").select("workspace_id")
    return _units_by_workspace(filter_usage(ctx.with_(allowed_workspaces=allowed), UsageFilter()))


@report("scope_subscription")
def scope_subscription(ctx: Ctx) -> DataFrame:
    return _units_by_workspace(filter_usage(ctx, UsageFilter(subscriptions=("sub-1", "SUB-3"), resource_group="rg-3")))


@report("filter_tag")
def filter_tag(ctx: Ctx) -> DataFrame:
    """Rows that carry a tag, and those where it has one value."""
    def counted(p: UsageFilter, name: str) -> DataFrame:
        return filter_usage(ctx, p).agg(F.count("*").alias("row_count")).select(F.lit(name).alias("filter"), "row_count")

    return counted(UsageFilter(tag_key="Env"), "present").unionByName(
        counted(UsageFilter(tag_key="Env", tag_value="dev"), "equals")
    )


def ctx_for_user(ctx: Ctx, email: str) -> Ctx:
    """``ctx`` restricted to the workspaces of the user's stored configuration.

    Without a configuration, without a workspace list in it, and with "*" in the list the user sees everything.
    """
    own = permissions.permissions_of(ctx.table("platform.user_permissions"), email).where(_restricted())
    if own.isEmpty():
        return ctx
    return ctx.with_(allowed_workspaces=own.select(F.explode("workspaces").alias("workspace_id")).distinct())


def _restricted() -> Column:
    return F.col("workspaces").isNotNull() & ~F.array_contains("workspaces", "*")


@report("visible_usage")
def visible_usage(ctx: Ctx) -> DataFrame:
    """What each configured user may see: usage rows and units of their workspaces, or of all."""
    by_workspace = _usage(ctx).groupBy("workspace_id").agg(F.count("*").alias("_n"), F.sum("usage_quantity").alias("_q"))
    users = permissions.parse_permissions(ctx.table("platform.user_permissions")).select("email", "workspaces")
    seen = [F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"), F.coalesce(total("_q"), F.lit(0.0)).alias("units")]
    own = users.where(_restricted()).select("email", F.explode_outer(F.array_distinct("workspaces")).alias("workspace_id"))
    some = own.join(by_workspace, "workspace_id", "left").groupBy("email").agg(*seen)
    everything = by_workspace.agg(*seen)
    rest = users.where(~_restricted()).select(
        "email", everything.select("row_count").scalar().alias("row_count"), everything.select("units").scalar().alias("units")
    )
    return some.unionByName(rest)


def _usage(ctx: Ctx) -> DataFrame:
    return ctx.table("billing.usage")


def _label_counts(df: DataFrame, key: str, label: Column, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("row_count")).withColumn(name, label)


@report("product_category")
def product_category(ctx: Ctx) -> DataFrame:
    return _label_counts(_usage(ctx), "sku_name", C.product_category(F.col("sku_name")), "product_category")


@report("product_category_fine")
def product_category_fine(ctx: Ctx) -> DataFrame:
    return _label_counts(_usage(ctx), "sku_name", C.product_category_fine(F.col("sku_name")), "product_category")


@report("origin_product_label")
def origin_product_label(ctx: Ctx) -> DataFrame:
    code = "billing_origin_product"
    return _label_counts(_usage(ctx), code, C.origin_product_label(F.col(code)), "label")


@report("infra_category")
def infra_category(ctx: Ctx) -> DataFrame:
    code = "billing_origin_product"
    return _label_counts(_usage(ctx), code, C.infra_category(F.col(code)), "label")


@report("resource_type")
def resource_type(ctx: Ctx) -> DataFrame:
    return _label_counts(_usage(ctx), "sku_name", C.resource_type(F.col("sku_name")), "resource_type")


@report("resource_id")
def resource_id(ctx: Ctx) -> DataFrame:
    return _usage(ctx).groupBy(C.resource_id().alias("resource_id")).agg(F.count("*").alias("row_count"))


@report("tag_alias")
def tag_alias(ctx: Ctx) -> DataFrame:
    return _usage(ctx).groupBy(
        C.tag_alias("product").alias("product_tag"), C.tag_alias("environment").alias("env_tag"),
        C.tag_alias("subscription").alias("subscription_tag"), C.tag_alias("resource_group").alias("resource_group_tag"),
    ).agg(F.count("*").alias("row_count"))


@report("env_tier")
def env_tier(ctx: Ctx) -> DataFrame:
    names = ctx.table("access.workspaces_latest").select("workspace_id", "workspace_name")
    rows = ctx.table("live.running_resources").join(names, "workspace_id", "left")
    tier = C.env_tier(F.col("name"), F.col("tags"), F.col("workspace_name"))
    return rows.select("resource_id", "name", tier.alias("_e")).select("resource_id", "name", "_e.*")


@report("env_from_workspace")
def env_from_workspace(ctx: Ctx) -> DataFrame:
    return ctx.table("access.workspaces_latest").select(
        "workspace_id", C.env_from_workspace(F.col("workspace_name")).alias("environment")
    )


@report("prod_workspace_filter")
def prod_workspace_filter(ctx: Ctx) -> DataFrame:
    prod = ctx.table("access.workspaces_latest").where(C.is_prod_name(F.col("workspace_name"))).select("workspace_id")
    return _units_by_workspace(_usage(ctx).join(prod, "workspace_id", "left_semi"))


@report("prod_tag_filter")
def prod_tag_filter(ctx: Ctx) -> DataFrame:
    return ctx.table("lakeflow.jobs").where(C.is_prod_tag()).groupBy("workspace_id").agg(
        F.count("*").alias("versions"), F.count_distinct("job_id").alias("jobs")
    )


@report("resource_path")
def resource_path(ctx: Ctx) -> DataFrame:
    ids = [F.col(f"usage_metadata.{i}").alias(i) for i in ID_FIELDS]
    rows = _usage(ctx).select("sku_name", *ids).distinct()
    return rows.withColumn("ui_path", C.resource_path(C.product_category_fine(F.col("sku_name"))))


@report("is_service_principal")
def is_service_principal(ctx: Ctx) -> DataFrame:
    email = F.col("user_identity.email")
    return ctx.table("access.audit").groupBy(email.alias("email")).agg(F.count("*").alias("row_count")).withColumn(
        "is_service_principal", C.is_service_principal(F.col("email"))
    )


@report("severity_by_duration")
def severity_by_duration(ctx: Ctx) -> DataFrame:
    """Severity of every running resource by its own start and the tier of its name or workspace."""
    names = ctx.table("access.workspaces_latest").select("workspace_id", "workspace_name")
    rows = ctx.table("live.running_resources").join(names, "workspace_id", "left")
    hours = ((F.unix_timestamp(day_start(ctx.day())) - F.unix_timestamp("started_at")) / 3600.0).cast("double")
    tier = F.coalesce(C.env_tier(F.col("name"), F.col("tags"), F.col("workspace_name"))["tier"], F.lit("other"))
    rows = rows.withColumns({"hours": hours, "tier": tier})
    level = C.severity_by_duration(F.col("hours"), F.col("tier"), F.col("service_type") == "Job Run")
    return rows.select("resource_id", "name", "service_type", "tier", rnd("hours", 1).alias("hours"), level.alias("severity"))


@report("subscription_name")
def subscription_name(ctx: Ctx) -> DataFrame:
    """Display names by id, in any case; ids without one stand for themselves."""
    names = ctx.table("access.workspaces_latest").where(F.col("subscription_id") != "sub-3").groupBy(
        F.lower("subscription_id").alias("_id")
    ).agg(F.concat(F.lit("Subscription of "), F.min("workspace_name")).alias("_name"))
    usage = _usage(ctx).groupBy("workspace_id").agg(F.sum("usage_quantity").alias("_u"))
    ids = ctx.table("access.workspaces_latest").select("workspace_id", F.upper("subscription_id").alias("subscription_id"))
    rows = usage.join(ids, "workspace_id").groupBy("subscription_id").agg(total("_u").alias("units"))
    return rows.join(names, F.lower("subscription_id") == F.col("_id"), "left").select(
        "subscription_id", "units", F.coalesce("_name", "subscription_id").alias("subscription_name")
    )


@report("ai_sku_filter")
def ai_sku_filter(ctx: Ctx) -> DataFrame:
    return _label_counts(_usage(ctx), "sku_name", C.is_ai_sku(F.col("sku_name")), "is_ai")


@report("infra_filter")
def infra_filter(ctx: Ctx) -> DataFrame:
    infra = C.is_infra(F.col("billing_origin_product"), F.col("usage_type")).alias("is_infra")
    return _usage(ctx).groupBy("usage_type", infra).agg(F.count("*").alias("row_count"))


@report("iam_filter")
def iam_filter(ctx: Ctx) -> DataFrame:
    return ctx.table("access.audit").groupBy("service_name", "action_name").agg(F.count("*").alias("row_count")).withColumn(
        "is_iam", C.is_iam_event()
    )


@report("human_filter")
def human_filter(ctx: Ctx) -> DataFrame:
    human = F.coalesce(C.is_human(F.col("user_identity.email"), VENDOR_DOMAIN), F.lit(False))
    return ctx.table("access.audit").groupBy(human.alias("is_human")).agg(F.count("*").alias("row_count"))


@report("interactive_query_filter")
def interactive_query_filter(ctx: Ctx) -> DataFrame:
    return ctx.table("query.history").groupBy("statement_type", C.is_interactive_query().alias("is_interactive")).agg(
        F.count("*").alias("row_count")
    )
