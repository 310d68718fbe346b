"""Labels derived from SKU, billing origin, tags, names and principals, all as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------------
# Substrings of a SKU name and the product they stand for; the first match wins.
PRODUCT_RULES = [
    (("ALL_PURPOSE",), "All Purpose Compute"),
    (("JOBS",), "Jobs Compute"),
    (("SQL",), "SQL Warehouse"),
    (("DLT", "DELTA_LIVE"), "Delta Live Tables"),
    (("SERVING", "MODEL_INFERENCE"), "Model Serving"),
    (("VECTOR_SEARCH",), "Vector Search"),
]
# The finer product list; the serverless rows need both words.
SERVERLESS_RULES = [
    ("SQL", "Serverless SQL"),
    ("JOBS", "Serverless Jobs"),
    ("ALL_PURPOSE", "Serverless Compute"),
    ("INFERENCE", "Serverless Inference"),
    ("DATABASE", "Serverless Database"),
]
FINE_RULES = [
    (("ALL_PURPOSE",), "Interactive Cluster"),
    (("SQL",), "SQL Warehouse"),
    (("JOBS",), "Jobs Cluster"),
    (("DLT", "DELTA_LIVE"), "DLT Pipeline"),
    (("MODEL_SERVING", "FOUNDATION_MODEL", "EXTERNAL_MODEL"), "Model Serving"),
    (("VECTOR_SEARCH",), "Vector Search"),
    (("STORAGE",), "Storage"),
    (("CONNECTIVITY",), "Connectivity"),
    (("EGRESS",), "Egress"),
]
RESOURCE_TYPE_RULES = [
    (("ALL_PURPOSE",), "cluster"),
    (("SQL",), "warehouse"),
    (("JOBS",), "job"),
    (("DLT", "DELTA_LIVE"), "pipeline"),
]
DRIFT_PRODUCT_RULES = [
    (("ALL_PURPOSE",), "All Purpose Compute"),
    (("SQL",), "SQL Warehouse"),
    (("JOBS",), "Jobs Compute"),
    (("DLT", "DELTA_LIVE"), "Delta Live Tables"),
]
ORIGIN_LABELS = {
    "JOBS": "Jobs Compute",
    "SQL": "SQL Warehouses",
    "DLT": "Delta Live Tables",
    "ALL_PURPOSE": "Interactive Clusters",
    "MODEL_SERVING": "Model Serving",
    "VECTOR_SEARCH": "Vector Search",
    "FEATURE_STORE": "Feature Store",
    "DELTA_SHARING": "Delta Sharing",
    "SERVERLESS": "Serverless",
}
INFRA_LABELS = {
    "NETWORKING": "Networking",
    "DEFAULT_STORAGE": "Default Storage",
    "JOBS": "Jobs",
    "SQL": "SQL Warehouses",
    "DLT": "Delta Live Tables",
    "ALL_PURPOSE": "Interactive Clusters",
    "MODEL_SERVING": "Model Serving",
    "VECTOR_SEARCH": "Vector Search",
}
INFRA_PRODUCTS = ("NETWORKING", "DEFAULT_STORAGE")
INFRA_USAGE_TYPES = ("STORAGE_SPACE", "NETWORK_BYTE", "NETWORK_HOUR", "API_OPERATION", "TOKEN")
AI_SKU_WORDS = ("FOUNDATION_MODEL", "EXTERNAL_MODEL", "MODEL_SERVING", "FEATURE_SERVING", "VECTOR_SEARCH")

TAG_SPELLINGS = {
    "product": ("ProductName", "productname", "Product", "product"),
    "environment": ("Environment", "environment", "Env", "env", "Environments", "environments"),
    "subscription": (
        "SubscriptionId", "subscriptionid", "SubscriptionID", "Subscription", "subscription",
        "AzureSubscriptionId", "SubscriptionName", "subscriptionname",
    ),
    "resource_group": (
        "ResourceGroup", "resourcegroup", "ResourceGroupName", "resource_group",
        "resourcegroupname", "RG", "rg",
    ),
}
PRODUCT_AREA_TAGS = ("ProductName", "Product")

# Environment words per tier in the order they are looked for; longer words first within a tier.
TIER_WORDS = {
    "dev": ("development", "sandbox", "nonprod", "dev"),
    "test": ("testing", "staging", "stage", "test", "qa"),
    "uat": ("uat",),
    "prod": ("production", "prod", "live", "prd"),
}
TIER_TAG_KEYS = ("environment", "env", "deployment_env", "stage", "tier")
# Hours after which a running service / job run is critical, then a warning.
TIER_HOURS = {
    "dev": ((8.0, 4.0), (4.0, 2.0)),
    "test": ((12.0, 6.0), (6.0, 3.0)),
    "uat": ((24.0, 12.0), (8.0, 4.0)),
    "prod": ((72.0, 48.0), (24.0, 8.0)),
    "other": ((8.0, 4.0), (4.0, 2.0)),
}
PROD_TAG_VALUES = ("prod", "production", "prd")

IAM_SERVICES = (
    "iamService", "accountsManager", "tokenManagement", "groups", "servicePrincipals", "users",
    "permissions", "iam", "accounts",
)
SP_ACTIONS = ("createServicePrincipal", "deleteServicePrincipal", "updateServicePrincipal")
TOKEN_ACTIONS = ("createToken", "deleteToken", "revokeToken")
GROUP_ACTIONS = (
    "createGroup", "deleteGroup", "updateGroup", "addMember", "removeMember",
    "addPrincipalToGroup", "removePrincipalFromGroup",
)
PERMISSION_ACTIONS = ("setPermissions", "updatePermissions", "changePermissions")
USER_ACTIONS = (
    "assignPrincipalToWorkspace", "unassignPrincipalFromWorkspace", "createUser", "deleteUser", "updateUser",
)
IAM_ACTIONS = SP_ACTIONS + GROUP_ACTIONS + TOKEN_ACTIONS + PERMISSION_ACTIONS + USER_ACTIONS
# -------------------------------------------------------------------------------------------------


def _any_contains(text: Column, words: Sequence[str]) -> Column:
    found = text.contains(words[0])
    for w in words[1:]:
        found = found | text.contains(w)
    return found


def first_match(text: Column, rules: Sequence[tuple[Sequence[str], str]], default: str) -> Column:
    """Label of the first rule one of whose words occurs in ``text``."""
    label = F
    for words, name in rules:
        label = label.when(_any_contains(text, words), F.lit(name))
    return label.otherwise(F.lit(default))


def lookup(key: Column, labels: Mapping[str, str]) -> Column:
    """Label of ``key`` in a small fixed table, NULL when it is not there."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return table[key]


def product_category(sku: Column) -> Column:
    return first_match(sku, PRODUCT_RULES, "Other")


def product_category_fine(sku: Column) -> Column:
    s = F.upper(F.coalesce(sku, F.lit("")))
    label = F
    for word, name in SERVERLESS_RULES:
        label = label.when(s.contains("SERVERLESS") & s.contains(word), F.lit(name))
    return label.otherwise(first_match(s, FINE_RULES, "Other"))


def resource_type(sku: Column) -> Column:
    return first_match(sku, RESOURCE_TYPE_RULES, "other")


def drift_product(sku: Column) -> Column:
    return first_match(sku, DRIFT_PRODUCT_RULES, "Other")


def _spelled_out(code: Column) -> Column:
    return F.initcap(F.replace(code, F.lit("_"), F.lit(" ")))


def origin_product_label(code: Column) -> Column:
    known = lookup(F.upper(F.coalesce(code, F.lit(""))), ORIGIN_LABELS)
    blank = F.when(F.coalesce(code, F.lit("")) == "", F.coalesce(code, F.lit("Other")))
    return F.coalesce(known, blank, _spelled_out(code))


def infra_category(code: Column) -> Column:
    known = lookup(F.upper(F.coalesce(code, F.lit(""))), INFRA_LABELS)
    return F.coalesce(known, _spelled_out(code), F.lit("Other"))


def is_infra(product: Column, usage_type: Column) -> Column:
    return F.coalesce(product, F.lit("")).isin(*INFRA_PRODUCTS) | F.coalesce(usage_type, F.lit("")).isin(
        *INFRA_USAGE_TYPES
    )


def is_ai_sku(sku: Column) -> Column:
    return _any_contains(sku, AI_SKU_WORDS)


def resource_id(meta: str = "usage_metadata") -> Column:
    """Cluster, else warehouse, else job run, else pipeline; blanks count as absent."""
    ids = ("cluster_id", "warehouse_id", "job_run_id", "dlt_pipeline_id")
    return F.coalesce(*[F.nullif(F.col(f"{meta}.{i}"), F.lit("")) for i in ids])


def tag_alias(kind: str, tags: str = "custom_tags", default: str | None = None) -> Column:
    """First non-null spelling of a tag; ``kind`` is a key of TAG_SPELLINGS or a tuple of spellings."""
    names = TAG_SPELLINGS[kind] if isinstance(kind, str) else kind
    found = [F.col(tags)[n] for n in names]
    return F.coalesce(*found, F.lit(default)) if default is not None else F.coalesce(*found)


def env_tier(name: Column, tags: Column, workspace_name: Column) -> Column:
    """struct(tier, label, source): from an environment tag, else the name, else the workspace name.

    Tag values must equal a tier word; names need only contain one. Development words are looked for
    first, so "nonprod" is a development name. All three fields are NULL when nothing matches.
    """

    def hit(tier, label, source):
        return F.struct(F.lit(tier).alias("tier"), label.alias("label"), F.lit(source).alias("source"))

    def tag_hit(entry: Column) -> Column:
        value = F.lower(entry["value"])
        found = F
        for tier, words in TIER_WORDS.items():
            found = found.when(value.isin(*words), hit(tier, value, "tag"))
        return found

    def name_hit(text: Column, source: str) -> Column:
        t = F.lower(text)
        found = F
        for tier, words in TIER_WORDS.items():
            for word in words:
                found = found.when(t.contains(word), hit(tier, F.lit(word), source))
        return found

    entries = F.filter(F.map_entries(tags), lambda e: F.lower(e["key"]).isin(*TIER_TAG_KEYS))
    from_tags = F.get(F.array_compact(F.transform(entries, tag_hit)), F.lit(0))
    return F.coalesce(from_tags, name_hit(name, "name"), name_hit(workspace_name, "workspace"))


def env_from_workspace(workspace_name: Column) -> Column:
    """prod, uat, test, dev by substring in that order; here "nonprod" is prod."""
    rules = [((w,), w) for w in ("prod", "uat", "test", "dev")]
    return first_match(F.lower(workspace_name), rules, "other")


def is_prod_name(workspace_name: Column) -> Column:
    return F.lower(workspace_name).contains("prod")


def is_prod_tag(tags: str = "tags") -> Column:
    return F.lower(F.col(tags)["Env"]).isin(*PROD_TAG_VALUES)


def severity_by_duration(hours: Column, tier: Column, is_job_run: Column) -> Column:
    """critical / warning / info by the tier's hour limits; unknown (negative) durations are info."""

    def limit(level: int) -> Column:
        found = F
        for name, (service, job_run) in TIER_HOURS.items():
            hours_ = F.when(is_job_run, F.lit(job_run[level])).otherwise(F.lit(service[level]))
            found = found.when(tier == name, hours_)
        return found

    return (
        F.when((hours >= 0) & (hours >= limit(0)), "critical")
        .when((hours >= 0) & (hours >= limit(1)), "warning")
        .otherwise("info")
    )


def subscription_name(ident: Column, names: Mapping[str, str]) -> Column:
    """Display name of a subscription id in any case, the id itself when it has none, '' for blank."""
    known = lookup(F.lower(F.trim(ident)), {k.strip().lower(): v for k, v in names.items()}) if names else F.lit(None)
    return F.coalesce(known, ident, F.lit(""))


def subscription_id(name_or_id: str, names: Mapping[str, str]) -> str:
    """The id for a display name or id given by a user; unknown values stand for themselves."""
    value = name_or_id.strip()
    if value.lower() in {k.lower() for k in names}:
        return value
    return {v.lower(): k for k, v in names.items()}.get(value.lower(), value)


def resource_path(product: Column, prefix: str = "") -> Column:
    """Relative deep link of a billed resource, by the most specific id present; '' when none is."""

    def ident(n: str) -> Column:
        return F.coalesce(F.col(prefix + n), F.lit(""))

    wh, pl, job, run = ident("warehouse_id"), ident("dlt_pipeline_id"), ident("job_id"), ident("job_run_id")
    ep, ep_id, cl, nb = ident("endpoint_name"), ident("endpoint_id"), ident("cluster_id"), ident("notebook_id")
    jobs_cluster = F.when(product.contains("Jobs"), F.lit("/configuration")).otherwise(F.lit(""))
    return (
        F.when(wh != "", F.concat(F.lit("sql/warehouses/"), wh))
        .when(pl != "", F.concat(F.lit("#joblist/pipelines/"), pl))
        .when(ep != "", F.concat(F.lit("ml/endpoints/"), ep))
        .when(ep_id != "", F.concat(F.lit("ml/endpoints/"), ep_id))
        .when(_any_contains(product, ("Serving", "Inference")), F.lit("ml/endpoints"))
        .when((job != "") & (run != ""), F.concat(F.lit("#job/"), job, F.lit("/run/"), run))
        .when(job != "", F.concat(F.lit("#job/"), job))
        .when(run != "", F.concat(F.lit("#job/runs/"), run))
        .when(cl != "", F.concat(F.lit("#setting/clusters/"), cl, jobs_cluster))
        .when(nb != "", F.concat(F.lit("#notebook/"), nb))
        .otherwise("")
    )


def is_service_principal(email: Column) -> Column:
    """Blank, or a local part that is all digits (ignoring - and _) or shaped like a UUID."""
    e = F.lower(F.trim(F.coalesce(email, F.lit(""))))
    local = F.split(e, "@")[0]
    parts = F.split(local, "-")
    uuid_like = (F.size(parts) == 5) & F.forall(parts, lambda p: F.length(p).isin(4, 8, 12))
    return (F.coalesce(email, F.lit("")) == "") | F.regexp_replace(local, "[-_]", "").rlike("^[0-9]+$") | uuid_like


def is_known_user(email: Column) -> Column:
    return email.isNotNull() & (F.trim(email) != "")


def is_human(email: Column, vendor_domain: str) -> Column:
    """A non-blank address outside the platform vendor's own mail domain."""
    return is_known_user(email) & ~F.endswith(email, F.lit("@" + vendor_domain))


def is_interactive_query() -> Column:
    """Statements a user ran themselves, other than unclassified ones."""
    by = F.col("executed_by")
    return (
        by.isNotNull() & (F.trim(by) != "") & (F.col("statement_type") != "OTHER") & (by == F.col("executed_as"))
    )


def is_iam_event() -> Column:
    return F.col("service_name").isin(*IAM_SERVICES) | F.col("action_name").isin(*IAM_ACTIONS)
