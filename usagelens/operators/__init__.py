"""Domain operators: each takes and returns DataFrames and is built from built-in
expressions, joins and aggregates only (no Python UDF, no window over a whole key)."""

from .cost import allocate_cost, priced_usage, statement_cost, statement_windows, usage_since
from .dashboards import audit_by_dashboard, audit_with_publisher, dashboard_publishers, dashboard_queries
from .latest import latest_per_key
from .lookups import scan, usage_by_sku
from .metadata import with_client_label, with_comment_metadata, with_comment_text
from .metrics import daily_average_sums, statement_metrics, with_fleet_averages, with_statement_flags
from .overlap import interval_overlap
from .position import with_position
from .runs import run_events, run_history, run_stats, run_totals, timeline_run_stats
from .schedules import latest_schedules, schedule_changes, schedule_with_runs

__all__ = [
    "allocate_cost",
    "audit_by_dashboard",
    "audit_with_publisher",
    "daily_average_sums",
    "dashboard_publishers",
    "dashboard_queries",
    "interval_overlap",
    "latest_per_key",
    "latest_schedules",
    "priced_usage",
    "run_events",
    "run_history",
    "run_stats",
    "run_totals",
    "scan",
    "schedule_changes",
    "schedule_with_runs",
    "statement_cost",
    "statement_metrics",
    "statement_windows",
    "timeline_run_stats",
    "usage_by_sku",
    "usage_since",
    "with_client_label",
    "with_comment_metadata",
    "with_comment_text",
    "with_fleet_averages",
    "with_position",
    "with_statement_flags",
]
