"""Checkable queries: each operator run on the test tables, projected to scalar columns.

Every query reads the whole driver tables (through the fixture mapping) and returns
scalars only: nested values are flattened, arrays joined in sorted order, decimals
cast to double and doubles rounded, so an independent SQL engine can compare values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import elapsed_seconds, epoch_seconds_between
from ..operators import (
    allocate_cost,
    audit_by_dashboard,
    audit_with_publisher,
    dashboard_publishers,
    dashboard_queries,
    interval_overlap,
    latest_per_key,
    latest_schedules,
    priced_usage,
    run_events,
    run_history,
    run_stats,
    run_totals,
    scan,
    schedule_changes,
    schedule_with_runs,
    statement_cost,
    statement_metrics,
    statement_windows,
    timeline_run_stats,
    usage_by_sku,
    with_client_label,
    with_comment_metadata,
    with_comment_text,
    with_fleet_averages,
    with_position,
    with_statement_flags,
)
from ..sources import Sources, fixture_sources
from .history import TOOL_COLUMNS, enhanced_history
from .node_cost import NODE_KEYS, node_cost_detail, node_cost_report
from .views import build_views, register_views

# Fixed parameters of the checks (test data covers 2024-01-01 .. 2024-01-30).
AS_OF = "2024-01-31"
DETAIL_NODE = "model.p.view"
ONE_DASHBOARD = "d3"
DIGITS = 6

Query = Callable[[SparkSession, str], DataFrame]


def scalars(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round doubles, decimals to rounded doubles; refuse nested output."""
    cols: list[Column] = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            # snap float noise at 9 places, then round half-up at `digits` places
            c = F.round(F.round(c.cast("double"), 9), digits)
        elif isinstance(f.dataType, (T.StructType, T.MapType, T.ArrayType)):
            raise TypeError(f"nested output column {f.name}")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _joined(arr: Column) -> Column:
    return F.array_join(F.sort_array(arr), ",")


def _src(spark: SparkSession, sf_dir: str) -> Sources:
    return fixture_sources(spark, sf_dir)


def _view_name(base: str, sf_dir: str) -> str:
    """A temp-view name per test folder, so queries over two folders never share a view."""
    tag = "".join(ch if ch.isalnum() else "_" for ch in sf_dir.rstrip("/").rsplit("/", 1)[-1])
    return f"usagelens_{base}_{tag}"


# --- statements and cost -------------------------------------------------------


def q_statement_metrics(spark, sf_dir):
    return scalars(statement_metrics(_src(spark, sf_dir).query_history))


def q_statement_flags(spark, sf_dir):
    df = with_statement_flags(statement_metrics(_src(spark, sf_dir).query_history))
    return scalars(df.select(
        "statement_id", "ReadDataAmountInGB", "UsedCacheFlag", "HasSpillFlag", "ReadDataFlag",
        "UsedWorkerTasksFlag", "Calc_HasSpillFlag", "Calc_ReadDataFlag", "Calc_UsedWorkerTasksFlag",
    ))


def q_fleet_averages(spark, sf_dir):
    hist = _src(spark, sf_dir).query_history
    df = with_fleet_averages(statement_metrics(hist), hist)
    return scalars(df.select(
        "statement_id", "QueryRuntimeSeconds", "WarehouseAvgQueryRuntime", "WarehouseAvgQueueTime",
        "WarehouseAvgProportionTimeQueueing",
    ))


def q_fleet_averages_by_warehouse(spark, sf_dir):
    hist = _src(spark, sf_dir).query_history
    df = with_fleet_averages(statement_metrics(hist), hist, by=["warehouse_id"])
    return scalars(df.select(
        "statement_id", "warehouse_id", "WarehouseAvgQueryRuntime", "WarehouseAvgQueueTime",
        "WarehouseAvgProportionTimeQueueing",
    ))


def _comment_query(missing):
    def q(spark, sf_dir):
        df = with_comment_metadata(with_comment_text(_src(spark, sf_dir).query_history), missing=missing)
        return df.select(
            "statement_id", "dbt_metadata_json", "app", "node_id", "profile_name", "target_name",
            "connection_name", "dbt_version", "dbt_databricks_version", "node_or_connection",
        )
    return q


def q_client_label(spark, sf_dir):
    df = with_client_label(with_comment_metadata(with_comment_text(_src(spark, sf_dir).query_history)))
    return df.select("statement_id", "client_application", "DBT_Query_Type")


def q_priced_usage(spark, sf_dir):
    s = _src(spark, sf_dir)
    return scalars(priced_usage(s.usage, s.list_prices))


def q_interval_overlap(spark, sf_dir):
    s = _src(spark, sf_dir)
    left = statement_windows(s.query_history).select("statement_id", "warehouse_id", "start_time", "end_time")
    right = priced_usage(s.usage, s.list_prices).select("warehouse_id", "usage_start_time", "usage_end_time")
    pairs = interval_overlap(
        left, right, "warehouse_id", "start_time", "end_time", "usage_start_time", "usage_end_time", right_spans=s.usage.select("usage_start_time", "usage_end_time")
    )
    return pairs.select("statement_id", "warehouse_id", "start_time", "end_time", "usage_start_time", "usage_end_time")


def q_allocate_cost(spark, sf_dir):
    s = _src(spark, sf_dir)
    pairs = allocate_cost(statement_windows(s.query_history), priced_usage(s.usage, s.list_prices), usage=s.usage)
    return scalars(pairs.select(
        "statement_id", "warehouse_id", "usage_start_time", "query_duration_in_interval", "cost_per_second",
    ))


def q_statement_cost(spark, sf_dir):
    s = _src(spark, sf_dir)
    return scalars(statement_cost(s.query_history, s.usage, s.list_prices))


def q_elapsed_vs_epoch_seconds(spark, sf_dir):
    h = _src(spark, sf_dir).query_history
    return h.select(
        "statement_id",
        elapsed_seconds("start_time", "end_time").alias("elapsed_seconds"),
        epoch_seconds_between("start_time", "end_time").alias("epoch_seconds"),
    )


def q_enhanced_history(spark, sf_dir):
    df = enhanced_history(_src(spark, sf_dir), as_of=AS_OF, days=15)
    return scalars(df.drop("parsed_dbt_comment"))


def q_node_cost_report(spark, sf_dir):
    return scalars(node_cost_report(_src(spark, sf_dir), as_of=AS_OF, days=10, min_runtime=60))


def q_node_cost_detail(spark, sf_dir):
    df = node_cost_detail(_src(spark, sf_dir), node=DETAIL_NODE, as_of=AS_OF, days=10, min_runtime=1)
    return scalars(df.drop("parsed_dbt_comment"))


def q_enhanced_history_order(spark, sf_dir):
    """Positions of the flagship's rows, dearest first (rounded costs, so that sums in another order rank alike)."""
    df = scalars(enhanced_history(_src(spark, sf_dir), as_of=AS_OF, days=15, sort=False).select("workspace_id", "statement_id", "approx_query_cost"))
    return with_position(df, [F.desc("approx_query_cost"), F.asc("workspace_id"), F.asc("statement_id")])


def q_node_cost_order(spark, sf_dir):
    df = node_cost_report(_src(spark, sf_dir), as_of=AS_OF, days=10, min_runtime=60, sort=False)
    df = scalars(df.select(*NODE_KEYS, "num_runs", "sum_CPUTotalExecutionTime"))
    return with_position(df, [F.desc("sum_CPUTotalExecutionTime"), *map(F.asc, NODE_KEYS)])


def q_schedule_changes_order(spark, sf_dir):
    """Positions in the change history by job and time; a job's changes of one moment by what changed."""
    df = schedule_changes(_src(spark, sf_dir).audit_log).select("job_id", "event_time", "action_name", "workspace_id", "job_name", "schedule_cron")
    return with_position(df, [F.asc_nulls_first(c) for c in df.columns])


# --- schedules and runs ----------------------------------------------------------

def _CHANGE_SCALARS():
    return [
    "workspace_id", "event_time", "service_name", "action_name",
    F.col("user_identity.email").alias("user_email"), "schedule_cron",
    F.col("schedule_info.timezone_id").alias("schedule_timezone"), "pause_status", "status", "from_redash_ind",
    "job_id", "job_name", "alert_id", "dashboard_id", "query_id", "warehouse_id", "error",
    F.col("update_info.schedule.quartz_cron_expression").alias("update_cron"),
    # the whole map and struct that the view passes on, flattened
    F.col("request_params")["name"].alias("param_name"), F.col("request_params")["job_id"].alias("param_job_id"),
    F.col("request_params")["jobId"].alias("param_job_id_2"), F.size("request_params").cast("long").alias("n_params"),
    F.col("response.result").alias("response_result"),
]


def _LATEST_SCALARS():
    return [
    "workspace_id", "last_updated_time", "service_name", F.col("user_identity.email").alias("user_email"),
    "last_updated_action", "schedule_cron", "pause_status",
    F.col("schedule_info.quartz_cron_expression").alias("schedule_info_cron"),
    F.col("schedule_info.timezone_id").alias("schedule_timezone"), "status", "from_redash_ind", "job_id",
    "job_name", "dashboard_id", "alert_id", "query_id", "warehouse_id", "error",
    F.col("request_params")["name"].alias("param_name"), F.col("response.result").alias("response_result"),
]


def q_schedule_changes(spark, sf_dir):
    return schedule_changes(_src(spark, sf_dir).audit_log).select(*_CHANGE_SCALARS())


def q_latest_per_key(spark, sf_dir):
    tl = _src(spark, sf_dir).task_run_timeline
    return latest_per_key(tl, "job_id", "period_start_time").select(
        "job_id", "run_id", "task_key", "result_state", "period_start_time"
    )


def q_latest_schedules(spark, sf_dir):
    return latest_schedules(schedule_changes(_src(spark, sf_dir).audit_log)).select(*_LATEST_SCALARS())


def q_schedule_with_runs(spark, sf_dir):
    audit = _src(spark, sf_dir).audit_log
    df = schedule_with_runs(latest_schedules(schedule_changes(audit)), run_totals(run_events(audit)))
    return df.select(
        "job_id", "workspace_id", "last_updated_time", "last_updated_action", "schedule_cron", "pause_status",
        "warehouse_id", "last_run_time", "total_num_runs", "total_run_duration_seconds",
    )


def q_timeline_run_stats(spark, sf_dir):
    df = timeline_run_stats(_src(spark, sf_dir).task_run_timeline)
    return df.withColumn("warehouses", F.array_join("warehouses", ",", "null"))  # in order: [a, b] and [b, a] differ


def q_run_events(spark, sf_dir):
    flat = [F.size("request_params").cast("long").alias("n_params"), F.col("request_params")["runId"].alias("param_run_id"),
            F.col("response.error_message").alias("response_error")]
    return run_events(_src(spark, sf_dir).audit_log).select("*", *flat).drop("request_params", "response")


def q_run_history(spark, sf_dir):
    return run_history(run_events(_src(spark, sf_dir).audit_log)).drop("request_params", "response")


def q_run_stats(spark, sf_dir):
    df = run_stats(run_events(_src(spark, sf_dir).audit_log))
    return df.withColumn("warehouses", _joined(F.col("warehouses")))


def q_run_stats_sql(spark, sf_dir):
    """Runs by trigger type and state, in Spark SQL over the registered run-history view."""
    view = _view_name("run_history", sf_dir)
    register_views(spark, {"run_history": build_views(_src(spark, sf_dir), as_of=AS_OF)["run_history"]}, {"run_history": view})
    return spark.sql(
        "SELECT trigger_type, run_state, count(*) AS run_rows, count(DISTINCT job_id) AS jobs, "
        "max(triggered_event_time) AS last_trigger FROM IDENTIFIER(:view) GROUP BY ALL",
        args={"view": view},
    )


# --- dashboards and look-ups -------------------------------------------------------

def _AUDIT_SCALARS():
    return [
    "workspace_id", "event_time", "event_date", "service_name", "action_name",
    F.col("user_identity.email").alias("user_email"), "user_agent", "request_id",
    F.col("request_params")["statement_id"].alias("param_statement_id"),
    F.col("response.status_code").alias("status_code"),
]


def q_dashboard_publishers(spark, sf_dir):
    return dashboard_publishers(_src(spark, sf_dir).audit_log)


def q_dashboard_queries(spark, sf_dir):
    s = _src(spark, sf_dir)
    df = dashboard_queries(s.audit_log, s.query_history, dashboard_publishers(s.audit_log))
    return scalars(df.withColumn("warehouse_id", F.col("compute.warehouse_id")).drop("compute"))


def q_audit_by_dashboard(spark, sf_dir):
    return audit_by_dashboard(_src(spark, sf_dir).audit_log, ONE_DASHBOARD).select(*_AUDIT_SCALARS())


def q_audit_with_publisher(spark, sf_dir):
    audit = _src(spark, sf_dir).audit_log
    return audit_with_publisher(audit, dashboard_publishers(audit)).select(*_AUDIT_SCALARS(), "dashboard_id", "publisher")


def q_usage_by_sku(spark, sf_dir):
    u = usage_by_sku(_src(spark, sf_dir).usage)
    return scalars(u.select(
        "usage_start_time", "usage_end_time", "usage_date", "sku_name", "usage_quantity",
        F.col("usage_metadata.warehouse_id").alias("warehouse_id"),
    ))


def q_warehouse_events(spark, sf_dir):
    name = _view_name("warehouse_events", sf_dir)
    _src(spark, sf_dir).warehouse_events.createOrReplaceTempView(name)
    return scan(spark, name)


QUERIES: dict[str, Query] = {
    "statement_metrics": q_statement_metrics,
    "statement_flags": q_statement_flags,
    "fleet_averages": q_fleet_averages,
    "fleet_averages_by_warehouse": q_fleet_averages_by_warehouse,
    "comment_metadata": _comment_query(None),
    "comment_metadata_filled": _comment_query("None"),
    "client_label": q_client_label,
    "priced_usage": q_priced_usage,
    "interval_overlap": q_interval_overlap,
    "allocate_cost": q_allocate_cost,
    "statement_cost": q_statement_cost,
    "elapsed_vs_epoch_seconds": q_elapsed_vs_epoch_seconds,
    "enhanced_history": q_enhanced_history,
    "node_cost_report": q_node_cost_report,
    "node_cost_detail": q_node_cost_detail,
    "enhanced_history_order": q_enhanced_history_order,
    "node_cost_order": q_node_cost_order,
    "schedule_changes": q_schedule_changes,
    "schedule_changes_order": q_schedule_changes_order,
    "latest_per_key": q_latest_per_key,
    "latest_schedules": q_latest_schedules,
    "schedule_with_runs": q_schedule_with_runs,
    "timeline_run_stats": q_timeline_run_stats,
    "run_events": q_run_events,
    "run_history": q_run_history,
    "run_stats": q_run_stats,
    "run_stats_sql": q_run_stats_sql,
    "dashboard_publishers": q_dashboard_publishers,
    "dashboard_queries": q_dashboard_queries,
    "audit_by_dashboard": q_audit_by_dashboard,
    "audit_with_publisher": q_audit_with_publisher,
    "usage_by_sku": q_usage_by_sku,
    "warehouse_events": q_warehouse_events,
}

# tool-column list re-exported for tests
__all__ = ["AS_OF", "QUERIES", "TOOL_COLUMNS", "scalars"]
