"""Declared schemas (DDL) of the logical input tables; for typed empty frames and streaming reads."""

from __future__ import annotations

SCHEMAS: dict[str, str] = {
    "billing.usage": """
        record_id string, account_id string, workspace_id string, sku_name string, cloud string,
        usage_start_time timestamp, usage_end_time timestamp, usage_date date,
        custom_tags map<string,string>, usage_unit string, usage_quantity decimal(18,4),
        usage_type string, billing_origin_product string,
        identity_metadata struct<run_as:string,created_by:string>,
        usage_metadata struct<cluster_id:string,warehouse_id:string,job_id:string,job_run_id:string,
            dlt_pipeline_id:string,notebook_id:string,endpoint_name:string,endpoint_id:string>""",
    "billing.list_prices": """
        price_start_time timestamp, price_end_time timestamp, sku_name string, cloud string,
        currency_code string, usage_unit string,
        pricing struct<default:decimal(18,6)>""",
    "access.workspaces_latest": """
        workspace_id string, workspace_name string, workspace_url string, workspace_status string,
        cloud string, region string, subscription_id string, resource_group string""",
    "access.audit": """
        workspace_id string, event_time timestamp, event_date date, source_ip_address string,
        user_agent string, user_identity struct<email:string>, service_name string,
        action_name string, request_params string, response struct<statusCode:int>,
        event_id string""",
    "platform.request_log": """
        request_id string, client string, event_time timestamp, service_name string, status_code int, headers string""",
    "access.table_lineage": """
        source_catalog string, source_schema string, source_table string,
        target_catalog string, target_schema string, target_table string, event_time timestamp""",
    "access.column_lineage": """
        source_catalog string, source_schema string, source_table string, source_column string,
        target_catalog string, target_schema string, target_table string, target_column string,
        event_time timestamp""",
    "compute.clusters": """
        cluster_id string, cluster_name string, workspace_id string, owned_by string,
        cluster_source string, runtime_version string, driver_node_type string,
        worker_node_type string, min_autoscale_workers bigint, max_autoscale_workers bigint,
        auto_termination_minutes bigint, change_time timestamp, delete_time timestamp""",
    "compute.warehouses": """
        warehouse_id string, warehouse_name string, workspace_id string, warehouse_type string,
        warehouse_size string, min_clusters int, max_clusters int, auto_stop_minutes int,
        change_time timestamp, delete_time timestamp""",
    "dashboards.published_events": """
        workspace_id string, dashboard_id string, dashboard_name string, event_type string,
        user_id string, event_time timestamp""",
    "networking.vpc_endpoints": """
        workspace_id string, endpoint_id string, endpoint_name string, resource_id string,
        region string, status string""",
    "query.history": """
        statement_id string, executed_by string, executed_as string,
        compute struct<warehouse_id:string>, statement_type string, statement_text string,
        start_time timestamp, total_duration_ms bigint, read_bytes bigint, read_rows bigint,
        error_message string""",
    "platform.cloud_costs": """
        cloud_provider string, account_id string, account_name string, usage_date date,
        service_name string, service_category string, sku_description string, usage_unit string,
        usage_quantity double, unit_price double, cost_usd double, currency string,
        pricing_model string, region string, resource_group string, tags map<string,string>,
        ingested_at timestamp""",
    "platform.user_permissions": """
        email string, config string, updated_at timestamp, updated_by string""",
}
