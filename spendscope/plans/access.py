"""Who may reach what: grants, policies, principals, the permission graph. Lists come as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.context import Ctx
from spendscope.functions.measures import desc
from spendscope.plans.registry import report

EVERYONE = "account users"


def _clean(df: DataFrame, *names: str) -> DataFrame:
    """Trimmed columns, without rows where one of them is blank."""
    df = df.select(*[F.trim(F.coalesce(n, F.lit(""))).alias(n) for n in names])
    for n in names:
        df = df.where(F.col(n) != "")
    return df


@report("catalog_grants")
def catalog_grants(ctx: Ctx) -> DataFrame:
    return _clean(ctx.table("information_schema.catalog_privileges"), "grantee", "catalog_name", "privilege_type")


@report("catalog_discovery")
def catalog_discovery(ctx: Ctx) -> DataFrame:
    """All catalogs listed or granted on, without internal ones."""
    listed = ctx.table("information_schema.catalogs").select("catalog_name")
    granted = ctx.table("information_schema.catalog_privileges").select("catalog_name")
    return _clean(listed.unionByName(granted), "catalog_name").where(~F.startswith("catalog_name", F.lit("__"))).distinct()


@report("schema_grants")
def schema_grants(ctx: Ctx) -> DataFrame:
    table = ctx.table("information_schema.schema_privileges")
    return _clean(table, "grantee", "catalog_name", "schema_name", "privilege_type")


@report("row_filters")
def row_filters(ctx: Ctx) -> DataFrame:
    return ctx.table("information_schema.row_filters").select(
        "catalog_name", "schema_name", "table_name", "filter_name", "filter_body"
    ).orderBy("catalog_name", "schema_name", "table_name")


@report("column_masks")
def column_masks(ctx: Ctx) -> DataFrame:
    return ctx.table("information_schema.column_masks").select(
        "catalog_name", "schema_name", "table_name", "column_name", "mask_name", "mask_body"
    ).orderBy("catalog_name", "schema_name", "table_name", "column_name")


def _grants(ctx: Ctx) -> DataFrame:
    """Catalog and schema grants in one shape, with the grantee resolved to a principal name.

    A grantee is an id, or a name in any case, of a user or group; others stay as they are.
    """
    both = catalog_grants(ctx).withColumn("schema_name", F.lit(None).cast("string")).unionByName(schema_grants(ctx))
    # One list of names by id and by lower-case name, joined twice: the same exchange serves both.
    u_name = F.coalesce(F.nullif("email", F.lit("")), F.nullif("display_name", F.lit("")), F.col("user_id"))

    def named(df: DataFrame, key: str, by_id, name: str) -> DataFrame:
        none = F.lit(None).cast("string")
        ways = F.array(F.struct(F.col(key).alias("k"), by_id.alias("i"), none.alias("n")), F.struct(F.lower(name).alias("k"), none.alias("i"), F.col(name).alias("n")))
        return df.select(F.explode(ways).alias("w")).select("w.*")

    names = named(ctx.table("directory.users"), "user_id", u_name, "email").unionByName(
        named(ctx.table("directory.groups"), "group_id", F.col("group_name"), "group_name")
    ).groupBy("k").agg(F.max("i").alias("i"), F.max("n").alias("n"))
    return (
        both.join(names.toDF("_k1", "_i1", "_n1"), F.col("grantee") == F.col("_k1"), "left")
        .join(names.toDF("_k2", "_i2", "_n2"), F.lower("grantee") == F.col("_k2"), "left")
        .withColumn("principal", F.coalesce("_i1", "_n2", "grantee")).drop("_k1", "_i1", "_n1", "_k2", "_i2", "_n2")
    )


@report("join_principal_resolve")
def join_principal_resolve(ctx: Ctx) -> DataFrame:
    return _grants(ctx).groupBy("grantee", "principal").agg(F.count("*").alias("grants"))


def _memberships(ctx: Ctx) -> DataFrame:
    """User, group; every user also belongs to the implicit all-users group."""
    everyone = ctx.table("directory.users").select(F.col("email").alias("member"), F.lit(EVERYONE).alias("group_name"))
    return ctx.table("directory.group_members").select("member", "group_name").unionByName(everyone).distinct()


def _assignments(ctx: Ctx) -> DataFrame:
    return ctx.table("directory.workspace_assignments").select(
        F.coalesce("group_name", "service_principal_name", "user_name").alias("principal"),
        F.col("group_name").isNotNull().alias("is_group"), "workspace_id", "permission",
    )


@report("principal_map")
def principal_map(ctx: Ctx) -> DataFrame:
    """Everything known of every principal, one row per fact.

    ``fact`` is group, member, entitlement, workspace, catalog_grant or schema_grant; ``object`` is the
    related thing and ``detail`` the permission or privilege.
    """
    none = F.lit(None).cast("string")

    def facts(df: DataFrame, fact: str, principal: str, obj, detail=none) -> DataFrame:
        return df.select(F.col(principal).alias("principal"), F.lit(fact).alias("fact"), obj.alias("object"), detail.alias("detail"))

    members, on_schema = ctx.table("directory.group_members"), F.col("schema_name").isNotNull()
    thing = F.when(on_schema, F.concat_ws(".", "catalog_name", "schema_name")).otherwise(F.col("catalog_name"))
    granted = _grants(ctx).select("principal", F.when(on_schema, "schema_grant").otherwise("catalog_grant").alias("fact"), thing.alias("object"), F.col("privilege_type").alias("detail"))
    rows = (
        facts(_memberships(ctx), "group", "member", F.col("group_name"))
        .unionByName(facts(members, "member", "group_name", F.col("member")))
        .unionByName(facts(ctx.table("directory.group_entitlements"), "entitlement", "group_name", F.col("entitlement")))
        .unionByName(facts(_assignments(ctx), "workspace", "principal", F.col("workspace_id"), F.col("permission")))
        .unionByName(granted)
    )
    named = F.coalesce("principal", F.lit("")) != ""  # blank principals have no type
    return rows.join(_principal_types(ctx), "principal", "left").withColumn("principal_type", F.when(named, F.coalesce("principal_type", F.lit("unknown"))))


def _principal_types(ctx: Ctx, grants: DataFrame | None = None) -> DataFrame:
    """group over user over unknown; a name only seen in an assignment is a group if assigned as one.

    Principals that only hold ``grants`` are rows if these are given; they are unknown in any case.
    """
    rank = {"unknown": 0, "assigned_group": 1, "user": 2, "group": 3}

    def typed(df: DataFrame, name, kind) -> DataFrame:
        return df.select(name.alias("principal"), kind.cast("int").alias("_rank"))

    assigned = F.when(F.col("is_group"), F.lit(rank["assigned_group"])).otherwise(F.lit(rank["unknown"]))
    rows = (
        typed(ctx.table("directory.users"), F.col("email"), F.lit(rank["user"]))
        .unionByName(typed(ctx.table("directory.groups"), F.col("group_name"), F.lit(rank["group"])))
        .unionByName(typed(_assignments(ctx), F.col("principal"), assigned))
    )
    if grants is not None:
        rows = rows.unionByName(typed(grants, F.col("principal"), F.lit(rank["unknown"])))
    kind = F.when(F.col("_rank").isin(1, 3), "group").when(F.col("_rank") == 2, "user").otherwise("unknown")
    return rows.where(F.coalesce("principal", F.lit("")) != "").groupBy("principal").agg(F.max("_rank").alias("_rank")).select(
        "principal", kind.alias("principal_type")
    )


@report("principal_summary")
def principal_summary(ctx: Ctx) -> DataFrame:
    """Distinct objects and privileges per principal; groups first, then by number of grants."""
    qualified = F.when(F.col("schema_name").isNotNull(), F.concat_ws(".", "catalog_name", "schema_name"))
    counted = _grants(ctx).groupBy("principal").agg(
        F.count_distinct("catalog_name").alias("catalog_count"), F.count_distinct(qualified).alias("schema_count"),
        # The set of privilege names is bounded by the platform's privilege vocabulary.
        F.array_join(F.array_sort(F.collect_set("privilege_type")), ",").alias("privilege_types"),
        F.count("*").alias("total_grants"),
    )
    workspaces = _assignments(ctx).groupBy("principal").agg(F.count("*").alias("workspace_count"))
    known = _principal_types(ctx).join(counted.where(F.coalesce("principal", F.lit("")) != ""), "principal", "full_outer")
    rows = known.withColumn("principal_type", F.coalesce("principal_type", F.lit("unknown"))).join(workspaces, "principal", "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("catalog_count", "schema_count", "total_grants", "workspace_count")}
    return rows.withColumns({**zero, "privilege_types": F.coalesce("privilege_types", F.lit(""))}).orderBy(
        F.col("principal_type") != "group", desc("total_grants"), F.lower("principal")
    )


@report("access_summary")
def access_summary(ctx: Ctx) -> DataFrame:
    kind = F.col("principal_type")
    n = F.count("*").alias("n")
    return _principal_types(ctx, _grants(ctx)).agg(
        F.count_if(kind == "user").alias("total_users"), F.count_if(kind == "group").alias("total_groups"),
        F.count("*").alias("total_principals"),
    ).withColumns({
        "row_filters": ctx.table("information_schema.row_filters").agg(n).scalar(),
        "column_masks": ctx.table("information_schema.column_masks").agg(n).scalar(),
    })


@report("permission_edges")
def permission_edges(ctx: Ctx, privileges: tuple[str, ...] = (), node_types: tuple[str, ...] = ()) -> DataFrame:
    """Distinct edges user -> group, principal -> catalog, principal -> schema, catalog -> schema."""
    grants = _grants(ctx)
    if privileges:
        grants = grants.where(F.col("privilege_type").isin(*privileges))
    types = _principal_types(ctx)
    schema = F.concat_ws(".", "catalog_name", "schema_name")
    on_schema = F.col("schema_name").isNotNull()

    def edges(df, src, src_type, dst, dst_type, privilege) -> DataFrame:
        return df.select(src.alias("src"), src_type.alias("src_type"), dst.alias("dst"), F.lit(dst_type).alias("dst_type"), privilege.alias("privilege"))

    # A grant on a schema gives two edges, one on a catalog one: both from one pass over the resolved grants.
    kind = F.when(F.coalesce("principal", F.lit("")) != "", F.coalesce("principal_type", F.lit("unknown")))
    shape = lambda *c: F.struct(*(x.alias(n) for x, n in zip(c, ("src", "src_type", "dst", "dst_type", "privilege"), strict=True)))
    granted = shape(F.col("principal"), kind, F.when(on_schema, schema).otherwise(F.col("catalog_name")), F.when(on_schema, "schema").otherwise("catalog"), F.col("privilege_type"))
    contains = shape(F.col("catalog_name"), F.lit("catalog"), schema, F.lit("schema"), F.lit("CONTAINS"))
    of_grants = grants.join(types, "principal", "left").select(F.explode(F.when(on_schema, F.array(granted, contains)).otherwise(F.array(granted))).alias("e"))
    out = edges(_memberships(ctx), F.col("member"), F.lit("user"), F.col("group_name"), "group", F.lit("MEMBER")).unionByName(of_grants.select("e.*")).distinct()
    if node_types:
        out = out.where(F.col("src_type").isin(*node_types) & F.col("dst_type").isin(*node_types))
    return out


@report("grants_per_catalog")
def grants_per_catalog(ctx: Ctx) -> DataFrame:
    """Per catalog, principal and action, with the catalog's number of grants."""
    grants = catalog_grants(ctx).where(~F.startswith("catalog_name", F.lit("__")))
    per_catalog = grants.groupBy("catalog_name").agg(F.count("*").alias("grant_count"))
    rows = grants.groupBy("catalog_name", F.col("grantee").alias("principal"), F.col("privilege_type").alias("action")).agg(
        F.count("*").alias("times")
    )
    return rows.join(per_catalog, "catalog_name")
