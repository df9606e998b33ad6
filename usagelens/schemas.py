"""Schemas of the logical telemetry sources and of the JSON payloads inside them.

Nothing here is inferred: every JSON string is parsed with a declared schema, so a
parse never depends on sampling and unused fields are pruned by Catalyst.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- logical source tables (columns the reports read) -------------------------

WAREHOUSE_REF = T.StructType([T.StructField("warehouse_id", T.StringType())])

QUERY_HISTORY = T.StructType(
    [
        T.StructField("workspace_id", T.LongType()),
        T.StructField("statement_id", T.StringType()),
        T.StructField("executed_by", T.StringType()),
        T.StructField("statement_text", T.StringType()),
        T.StructField("compute", WAREHOUSE_REF),
        T.StructField("execution_status", T.StringType()),
        T.StructField("statement_type", T.StringType()),
        T.StructField("client_application", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("total_duration_ms", T.LongType()),
        T.StructField("total_task_duration_ms", T.LongType()),
        T.StructField("execution_duration_ms", T.LongType()),
        T.StructField("compilation_duration_ms", T.LongType()),
        T.StructField("waiting_at_capacity_duration_ms", T.LongType()),
        T.StructField("waiting_for_compute_duration_ms", T.LongType()),
        T.StructField("result_fetch_duration_ms", T.LongType()),
        T.StructField("start_time", T.TimestampNTZType()),
        T.StructField("end_time", T.TimestampNTZType()),
        T.StructField("update_time", T.TimestampNTZType()),
        T.StructField("read_bytes", T.LongType()),
        T.StructField("read_io_cache_percent", T.IntegerType()),
        T.StructField("from_result_cache", T.BooleanType()),
        T.StructField("spilled_local_bytes", T.LongType()),
    ]
)

USAGE = T.StructType(
    [
        T.StructField("usage_start_time", T.TimestampNTZType()),
        T.StructField("usage_end_time", T.TimestampNTZType()),
        T.StructField("usage_date", T.DateType()),
        T.StructField("sku_name", T.StringType()),
        T.StructField("usage_quantity", T.DoubleType()),
        T.StructField("usage_metadata", WAREHOUSE_REF),
    ]
)

LIST_PRICES = T.StructType(
    [
        T.StructField("sku_name", T.StringType()),
        T.StructField("pricing", T.StructType([T.StructField("default", T.DoubleType())])),
    ]
)

AUDIT_LOG = T.StructType(
    [
        T.StructField("workspace_id", T.LongType()),
        T.StructField("event_time", T.TimestampNTZType()),
        T.StructField("event_date", T.DateType()),
        T.StructField("service_name", T.StringType()),
        T.StructField("action_name", T.StringType()),
        T.StructField("user_identity", T.StructType([T.StructField("email", T.StringType())])),
        T.StructField("user_agent", T.StringType()),
        T.StructField("request_id", T.StringType()),
        T.StructField("request_params", T.MapType(T.StringType(), T.StringType())),
        T.StructField(
            "response",
            T.StructType(
                [
                    T.StructField("status_code", T.IntegerType()),
                    T.StructField("error_message", T.StringType()),
                    T.StructField("result", T.StringType()),
                ]
            ),
        ),
    ]
)

TASK_RUN_TIMELINE = T.StructType(
    [
        T.StructField("workspace_id", T.LongType()),
        T.StructField("job_id", T.StringType()),
        T.StructField("task_key", T.StringType()),
        T.StructField("result_state", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("period_start_time", T.TimestampNTZType()),
        T.StructField("period_end_time", T.TimestampNTZType()),
        T.StructField("compute_ids", T.ArrayType(T.StringType())),
    ]
)

WAREHOUSE_EVENTS = T.StructType(
    [
        T.StructField("warehouse_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("event_time", T.TimestampNTZType()),
    ]
)

SOURCE_SCHEMAS = {
    "query_history": QUERY_HISTORY,
    "usage": USAGE,
    "list_prices": LIST_PRICES,
    "audit_log": AUDIT_LOG,
    "task_run_timeline": TASK_RUN_TIMELINE,
    "warehouse_events": WAREHOUSE_EVENTS,
}

# --- JSON payload schemas ------------------------------------------------------
# These DDL strings must equal the payload shapes the reports parse.

JOB_RESULT_DDL = "struct<job_id:string>"

SCHEDULE_DDL = "struct<quartz_cron_expression:string, timezone_id:string, pause_status:string>"

NEW_SETTINGS_DDL = (
    "struct<schedule:struct<quartz_cron_expression:string, timezone_id:string, pause_status:string>, "
    "tasks:array<struct<task_key:string, sql_task:struct<dashboard:struct<dashboard_id:string, "
    "pause_subscriptions:boolean>, warehouse_id:string>>>>"
)

# The create payload carries one of three task shapes (alert, dashboard or query).
# One parse with the union of the three reads every field the three separate
# parses would read, so the string is scanned once instead of three times.
TASKS_DDL = (
    "array<struct<task_key:string, sql_task:struct<"
    "alert:struct<alert_id:string, pause_subscriptions:boolean>, "
    "dashboard:struct<dashboard_id:string, pause_subscriptions:boolean>, "
    "query:struct<query_id:string, pause_subscriptions:boolean>, "
    "warehouse_id:string>>>"
)

COMMENT_MAP = T.MapType(T.StringType(), T.StringType())
