"""Reports that belong on one page, as named frames."""

from __future__ import annotations

from pyspark.sql import DataFrame

from spendscope.context import Ctx
from spendscope.plans.registry import REPORTS

BUNDLES: dict[str, tuple[str, ...]] = {
    "executive": (
        "spend_scorecard", "month_end_projection", "exec_cost_trend", "run_rate", "top_workspaces", "top_products",
        "product_area_spend", "job_health", "active_users", "savings_opportunities", "governance_signals", "sla_breaches",
        "chargeback", "infra_costs", "forecast_7d", "pareto", "pareto_top", "annual_forecast",
    ),
    "cost": ("cost_summary", "cost_daily_trend", "cost_by_product", "cost_by_workspace"),
    "tags": ("cost_by_tag", "cost_by_tag_env", "tag_values", "tag_keys"),
    "filters": ("filter_options", "tag_keys", "resource_groups"),
    "spike": (
        "spike_totals", "spike_by_workspace", "spike_resources", "spike_by_product", "spike_top_resources", "spike_by_job",
        "spike_job_runs",
    ),
    "running": ("running_anomalies", "billing_snapshot", "warehouse_session", "warehouse_event_session"),
    "anomalies": ("anomaly_summary", "resource_anomalies", "drift_alerts", "join_alert_context", "idle_resources"),
    "alerts": ("alert_summary", "alert_report", "alert_daily_spend", "sku_wow"),
    "compute": (
        "compute_summary", "cluster_sizing", "warehouse_sizing", "pipeline_sizing", "runtime_versions", "warehouse_sizes",
        "node_types", "job_cost_30d",
    ),
    "queries": (
        "query_summary", "query_daily_trend", "query_user_stats", "user_cost_attribution", "top_expensive_queries",
        "query_warehouse_stats", "slow_queries", "warehouse_events",
    ),
    "adoption": (
        "adoption_summary", "daily_active_users", "service_breakdown", "top_actions", "user_classes", "inactive_users",
    ),
    "ai": (
        "ai_summary", "gateway_daily", "model_breakdown", "gateway_by_user", "serving_trend", "serving_skus", "serving_by_user",
        "latency_percentiles", "latency_daily",
    ),
    "access": ("access_summary", "principal_summary", "principal_map", "permission_edges", "row_filters", "column_masks"),
    "directory": ("workspace_access", "workspace_groups", "workspace_users", "grants_per_catalog"),
    "governance": (
        "governance_summary", "iam_top_actions", "iam_top_actors", "iam_daily", "token_summary", "token_events",
        "group_summary", "group_events", "permission_events", "iam_events", "sp_events",
    ),
    "jobs": (
        "job_report_summary", "combined_sla", "job_daily", "job_report", "join_job_inventory", "pipeline_runs",
        "task_bottlenecks", "pipelines_inventory", "pipeline_updates",
    ),
    "lineage": (
        "table_lineage_edges", "lineage_tables", "column_lineage", "serving_summary", "serving_daily", "ml_experiments",
        "ml_runs", "ml_runs_summary", "ml_models",
    ),
    "storage": (
        "storage_summary", "catalog_summary", "table_types", "optimization_summary", "optimization_ops", "table_inventory",
        "workspace_inventory",
    ),
    "platform": (
        "platform_summary", "private_endpoints", "endpoint_status", "endpoints_by_workspace", "dashboard_daily",
        "top_dashboards", "top_dashboard_users", "dashboard_event_types", "dashboard_inventory", "alert_states",
    ),
    "cluster_health": (
        "health_summary", "cluster_event_types", "cluster_event_daily", "failure_events", "scale_events", "busiest_clusters",
        "node_utilisation_daily", "cluster_utilisation",
    ),
    "marketplace": (
        "marketplace_summary", "listing_event_types", "listing_daily", "top_providers", "listing_types", "consumer_listings",
        "provider_listings", "listing_events",
    ),
    "cloud": (
        "cloud_providers", "cloud_accounts", "cloud_summary", "cloud_daily", "cloud_by_service", "cloud_by_account",
        "cloud_by_region", "cloud_by_sku", "cloud_by_category",
    ),
}


def bundle(ctx: Ctx, name: str) -> dict[str, DataFrame]:
    """The frames of one page. They are lazy, but for those that train a model or look for absent input."""
    return {section: REPORTS[section](ctx) for section in BUNDLES[name]}
