"""Dashboard activity from the audit log: publishers (D21), dashboard-issued statements
(D22), audit rows of one dashboard (D23), audit rows of published dashboards (D24)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ms_to_seconds, param

# Fixed values of the dashboard reports.
DASHBOARDS_SERVICE = "dashboards"
PUBLISH_ACTION = "publishDashboard"
EXECUTE_ACTION = "executeQuery"
PUBLISHED_SINCE = "2023-01-01"
SCHEDULED_AGENT_PATTERN = "%lakeview_processing%"
SCHEDULED_MODE, INTERACTIVE_MODE = "scheduled", "interactive"
DASHBOARD_KEY, STATEMENT_KEY = "dashboard_id", "statement_id"

# history columns replaced by derived ones in the dashboard view
_REPLACED = [
    "workspace_id", "statement_id", "executed_by", "total_duration_ms", "waiting_for_compute_duration_ms",
    "waiting_at_capacity_duration_ms", "execution_duration_ms", "compilation_duration_ms",
    "total_task_duration_ms", "result_fetch_duration_ms", "start_time", "end_time", "update_time",
]
_SECONDS = [
    ("total_duration", "total_duration_ms"),
    ("waiting_for_compute_duration", "waiting_for_compute_duration_ms"),
    ("waiting_at_capacity_duration", "waiting_at_capacity_duration_ms"),
    ("execution_duration", "execution_duration_ms"),
    ("compilation_duration", "compilation_duration_ms"),
    ("total_task_duration", "total_task_duration_ms"),
    ("result_fetch_duration", "result_fetch_duration_ms"),
]


def dashboard_publishers(audit: DataFrame, since: str = PUBLISHED_SINCE) -> DataFrame:
    """One publisher per dashboard: the email of its newest publish event
    (ties broken by the larger email), a partial aggregate so hot dashboards stay split."""
    email = F.col("user_identity.email")
    return (
        audit.where((F.col("event_date") >= F.lit(since).cast("date")) & (F.col("action_name") == PUBLISH_ACTION))
        .groupBy(param(DASHBOARD_KEY).alias("dashboard_id"))
        .agg(F.max_by(email, F.struct(F.col("event_time"), email)).alias("publisher"))
    )


def _by_dashboard(publishers: DataFrame, key: str) -> tuple[DataFrame, Column]:
    """The publishers and the condition to join them on ``key``.

    NULL dashboards are left out first, so the null-safe comparison means equality; written so, its
    keys differ from those the publishers were grouped by, and each side of a shuffled join has an
    exchange of its own that AQE can split at a hot dashboard.
    """
    p = publishers.where(F.col("dashboard_id").isNotNull()).select(F.col("dashboard_id").alias("_p_dashboard_id"), "publisher")
    return p, F.col(key).eqNullSafe(F.col("_p_dashboard_id"))


def dashboard_queries(
    audit: DataFrame,
    history: DataFrame,
    publishers: DataFrame,
    scheduled_pattern: str = SCHEDULED_AGENT_PATTERN,
) -> DataFrame:
    """Each statement a dashboard issued, with its mode (scheduled agent or
    interactive), owner (publisher, else the executor), durations in seconds, dates and
    the remaining history columns. Statements and dashboards are matched by id only."""
    a = audit.where(F.col("action_name") == EXECUTE_ACTION).select(
        F.col("workspace_id").alias("_a_workspace_id"),
        param(DASHBOARD_KEY).alias("dashboard_id"),
        "request_id",
        param(STATEMENT_KEY).alias("_a_statement_id"),
        "user_agent",
        "action_name",
        "event_date",
    )
    rest = [c for c in history.columns if c not in _REPLACED]
    joined = a.join(history, a["_a_statement_id"] == history["statement_id"])
    joined = joined.join(*_by_dashboard(publishers, "dashboard_id"), "left")
    return joined.select(
        F.col("_a_workspace_id").alias("workspace_id"),
        "dashboard_id",
        "request_id",
        "statement_id",
        F.when(F.col("user_agent").ilike(scheduled_pattern), SCHEDULED_MODE).otherwise(INTERACTIVE_MODE).alias("mode"),
        F.coalesce(F.col("publisher"), F.col("executed_by")).alias("user_owner"),
        *[ms_to_seconds(src).alias(name) for name, src in _SECONDS],
        F.col("start_time").cast("date").alias("start_date"),
        F.col("end_time").cast("date").alias("end_date"),
        F.col("update_time").cast("date").alias("update_date"),
        "action_name",
        "event_date",
        *rest,
    )


def audit_by_dashboard(audit: DataFrame, dashboard_id: str) -> DataFrame:
    """All audit rows of one dashboard."""
    return audit.where((F.col("service_name") == DASHBOARDS_SERVICE) & (param(DASHBOARD_KEY) == dashboard_id))


def audit_with_publisher(audit: DataFrame, publishers: DataFrame) -> DataFrame:
    """Every audit row of a dashboard that has a publisher, with that publisher.

    Rows that name no dashboard, most of a log, meet nothing and go before the join: the null-safe comparison
    would send them all to one task.
    """
    keyed = audit.withColumn("_d_key", param(DASHBOARD_KEY)).where(F.col("_d_key").isNotNull())
    return keyed.join(*_by_dashboard(publishers, "_d_key")).select(*audit.columns, F.col("_d_key").alias("dashboard_id"), "publisher")
