"""Build the saved views of the reports and expose them by name to Spark SQL."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..operators.dashboards import dashboard_publishers, dashboard_queries
from ..operators.lookups import usage_by_sku
from ..operators.runs import run_events, run_history, run_stats, run_totals, timeline_run_stats
from ..operators.schedules import latest_schedules, schedule_changes, schedule_with_runs
from ..sources import Sources
from .history import AsOf, enhanced_history
from .node_cost import node_cost_report

DEFAULT_NAMES = {
    "enhanced_query_history": "enhanced_query_history",
    "schedule_history": "schedule_history",
    "schedule_latest": "schedule_latest",
    "run_history": "run_history",
    "dashboard_history": "dashboard_history",
}


def build_views(src: Sources, as_of: AsOf = None) -> dict[str, DataFrame]:
    """The five views of the reports, lazily planned."""
    changes = schedule_changes(src.audit_log)
    return {
        "enhanced_query_history": enhanced_history(src, as_of=as_of, sort=False),
        "schedule_history": changes,
        "schedule_latest": latest_schedules(changes),
        "run_history": run_history(run_events(src.audit_log)),
        "dashboard_history": dashboard_queries(
            src.audit_log, src.query_history, dashboard_publishers(src.audit_log)
        ),
    }


def build_reports(src: Sources, as_of: AsOf = None) -> dict[str, DataFrame]:
    """The reports that sit on top of the views (sorted as the reports are), lazily planned,
    so SQL users can register and query them by name next to the views."""
    changes = schedule_changes(src.audit_log)
    events = run_events(src.audit_log)
    return {
        "node_cost_report": node_cost_report(src, as_of=as_of),
        "timeline_run_stats": timeline_run_stats(src.task_run_timeline),
        "run_stats": run_stats(events),
        "schedule_with_runs": schedule_with_runs(latest_schedules(changes), run_totals(events)),
        "dashboard_publishers": dashboard_publishers(src.audit_log),
        "serverless_sql_usage": usage_by_sku(src.usage),
    }


def register_views(
    spark: SparkSession, frames: Mapping[str, DataFrame], names: Mapping[str, str] | None = None
) -> dict[str, str]:
    """Register each frame as a temporary view (``names`` maps logical name to view name).

    Views stay logical, as in the reports: every query on them is planned by Catalyst
    against the sources. Returns logical name -> registered name. A name with a dot would
    have to be a catalog view, which Spark keeps as SQL text: a DataFrame has none, so such a
    name is refused here; :func:`save_views` stores the rows under it instead.
    """
    names = {**DEFAULT_NAMES, **(names or {})}
    out = {}
    for logical, df in frames.items():
        view = names.get(logical, logical)
        if "." in view:
            raise ValueError(f"{view}: a DataFrame can only be a temporary view, whose name has one part; save_views stores it in the catalog")
        df.createOrReplaceTempView(view)
        out[logical] = view
    return out


def save_views(frames: Mapping[str, DataFrame], names: Mapping[str, str]) -> dict[str, str]:
    """Store each frame as a catalog table under its (two- or three-part) name, replacing an older one.

    Other sessions on the catalog read it by that name, and refresh it by calling this again; the
    rows are those of the moment, unlike a view's. Every frame needs a name.
    """
    if missing := sorted(set(frames) - set(names)):
        raise ValueError(f"no name given for: {', '.join(missing)}")
    for logical, df in frames.items():
        df.write.mode("overwrite").saveAsTable(names[logical])
    return {k: names[k] for k in frames}
