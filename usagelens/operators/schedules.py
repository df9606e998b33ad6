"""Scheduled assets rebuilt from the audit log: change history (D11), latest state (D13),
latest state with run statistics (D14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import first_of, param
from ..schemas import JOB_RESULT_DDL, NEW_SETTINGS_DDL, SCHEDULE_DDL, TASKS_DDL
from .latest import latest_per_key

# Service and actions of asset changes; the origin flag value kept;
# request-parameter keys of the jobs service payloads.
JOBS_SERVICE = "jobs"
CHANGE_ACTIONS = ["create", "update", "delete"]
DELETE_ACTION = "delete"
FLAGGED_ORIGIN = "true"
JOB_ID_KEYS = ["job_id", "jobId"]
TASKS_KEY = "tasks"
SCHEDULE_KEY = "schedule"
NEW_SETTINGS_KEY = "new_settings"
NAME_KEY = "name"
ORIGIN_KEY = "is_from_redash"

CHANGE_COLUMNS = [
    "workspace_id", "event_time", "service_name", "action_name", "user_identity", "schedule_cron",
    "schedule_info", "pause_status", "status", "from_redash_ind", "job_id", "job_name", "alert_id",
    "dashboard_id", "query_id", "warehouse_id", "error", "request_params", "update_info", "response",
]
LATEST_COLUMNS = [
    "workspace_id", "last_updated_time", "service_name", "user_identity", "last_updated_action",
    "schedule_cron", "pause_status", "schedule_info", "status", "from_redash_ind", "job_id", "job_name",
    "dashboard_id", "alert_id", "query_id", "warehouse_id", "error", "request_params", "response",
]
RUN_INFO_COLUMNS = ["last_run_time", "total_num_runs", "total_run_duration_seconds"]


def job_id_of_event() -> F.Column:
    """Job id from the response payload, else from the request (two spellings)."""
    return F.coalesce(
        F.from_json(F.col("response.result"), JOB_RESULT_DDL)["job_id"], *[param(k) for k in JOB_ID_KEYS]
    )


def schedule_changes(audit: DataFrame, sort: bool = False) -> DataFrame:
    """Create / update / delete events of the jobs service with their payloads parsed.

    The three create-task shapes are parsed once with their union schema; an element
    of an empty or missing task array is NULL. ``sort`` orders by job and time (the
    view's order, which readers of a view cannot rely on, so it is off by default).
    """
    main = audit.where((F.col("service_name") == JOBS_SERVICE) & F.col("action_name").isin(CHANGE_ACTIONS)).select(
        "workspace_id",
        "event_time",
        "service_name",
        "action_name",
        "user_identity",
        job_id_of_event().alias("job_id"),
        F.from_json(param(TASKS_KEY), TASKS_DDL).alias("_tasks"),
        F.from_json(param(SCHEDULE_KEY), SCHEDULE_DDL).alias("schedule_info"),
        F.from_json(param(NEW_SETTINGS_KEY), NEW_SETTINGS_DDL).alias("update_info"),
        param(NAME_KEY).alias("job_name"),
        param(ORIGIN_KEY).alias("from_redash_ind"),
        F.col("response.status_code").alias("status"),
        F.col("response.error_message").alias("error"),
        "request_params",
        "response",
    )
    out = main.select(
        "workspace_id",
        "event_time",
        "service_name",
        "action_name",
        "user_identity",
        F.coalesce(
            F.col("schedule_info.quartz_cron_expression"), F.col("update_info.schedule.quartz_cron_expression")
        ).alias("schedule_cron"),
        "schedule_info",
        F.coalesce(F.col("schedule_info.pause_status"), F.col("update_info.schedule.pause_status")).alias("pause_status"),
        "status",
        "from_redash_ind",
        "job_id",
        "job_name",
        first_of(F.col("_tasks.sql_task.alert.alert_id")).alias("alert_id"),
        first_of(F.col("_tasks.sql_task.dashboard.dashboard_id")).alias("dashboard_id"),
        first_of(F.col("_tasks.sql_task.query.query_id")).alias("query_id"),
        F.coalesce(
            first_of(F.col("update_info.tasks.sql_task.warehouse_id")),
            first_of(F.col("_tasks.sql_task.warehouse_id")),
        ).alias("warehouse_id"),
        "error",
        "request_params",
        "update_info",
        "response",
    )
    return out.orderBy("job_id", "event_time") if sort else out


def latest_schedules(changes: DataFrame) -> DataFrame:
    """Newest event of each job, gaps filled from its newest cron / pause / create event.

    Kept as in the reports: a job needs at least one event of each of those kinds (the
    filtered left joins act as inner joins); tied event times multiply rows; deleted
    jobs and jobs whose newest event lacks the origin flag are dropped.

    Plan: an event stands for up to four roles (newest of the job, newest with a cron, with a pause
    status, with a schedule), one row each with the columns that role gives. Rank one of (job, role)
    is a group limit: Spark keeps only each task's newest rows before the shuffle, so the
    events are read once and a hot job sends its tied newest rows only. The rows left of a
    job (usually four) are gathered per role, and explodes rebuild their product. A job whose events all
    have a NULL time has all of them tied, as with rank one in the reports: n such events give up to n^4 rows.
    """
    last_cols = [
        "workspace_id", "event_time", "service_name", "user_identity", "action_name", "schedule_cron",
        "pause_status", "schedule_info", "update_info", "status", "from_redash_ind", "job_name", "dashboard_id",
        "alert_id", "query_id", "warehouse_id", "error", "request_params", "response",
    ]
    cron_cols = ["schedule_cron", "pause_status", "schedule_info", "job_name", "dashboard_id", "alert_id", "query_id", "warehouse_id"]
    create_cols = ["job_name", "dashboard_id", "alert_id", "query_id", "warehouse_id"]
    has = {"last": F.lit(True)} | {r: F.col(c).isNotNull() for r, c in (("cron", "schedule_cron"), ("pause", "pause_status"), ("create", "schedule_info"))}
    roles = F.array_compact(F.array(*[F.when(cond, F.lit(r)) for r, cond in has.items()]))
    tagged = changes.where(F.col("job_id").isNotNull()).select("job_id", *last_cols, F.explode(roles).alias("_role"))
    # a role's row carries what that role gives, so that the rows kept and shuffled stay narrow
    only_last = [c for c in last_cols if c not in (*cron_cols, *create_cols, "event_time")]
    narrow = [F.when(F.col("_role") == "last", F.col(c)).alias(c) for c in only_last]
    tagged = tagged.select("job_id", "_role", "event_time", *dict.fromkeys([*cron_cols, *create_cols]), *narrow)
    newest = latest_per_key(tagged, ["job_id", "_role"], "event_time")
    flagged = (F.col("action_name") != DELETE_ACTION) & (F.col("from_redash_ind") == FLAGGED_ORIGIN)
    newest = newest.where((F.col("_role") != "last") | flagged)

    def role(name, cols):
        return F.collect_list(F.when(F.col("_role") == name, F.struct(*cols))).alias(f"_{name}")

    roles = newest.groupBy("job_id").agg(role("last", last_cols), role("cron", cron_cols), role("pause", ["pause_status"]), role("create", create_cols))
    rows = (
        roles.select("job_id", F.explode("_last").alias("last"), "_cron", "_pause", "_create")
        .select("job_id", "last", F.explode("_cron").alias("cron"), "_pause", "_create")
        .select("job_id", "last", "cron", F.explode("_pause").alias("pause"), "_create")
        .select("job_id", "last", "cron", "pause", F.explode("_create").alias("create"))
    )

    def fill(name: str, *roles_: str):
        return F.coalesce(F.col(f"last.{name}"), *[F.col(f"{r}.{name}") for r in roles_]).alias(name)

    return rows.select(
        "last.workspace_id",
        F.col("last.event_time").alias("last_updated_time"),
        "last.service_name",
        "last.user_identity",
        F.col("last.action_name").alias("last_updated_action"),
        fill("schedule_cron", "cron"),
        fill("pause_status", "cron", "pause"),
        F.coalesce(
            F.col("last.schedule_info"), F.col("cron.schedule_info"), F.col("last.update_info.schedule")
        ).alias("schedule_info"),
        "last.status",
        "last.from_redash_ind",
        "job_id",
        fill("job_name", "cron", "create"),
        fill("dashboard_id", "cron", "create"),
        fill("alert_id", "cron", "create"),
        fill("query_id", "cron", "create"),
        fill("warehouse_id", "cron", "create"),
        "last.error",
        "last.request_params",
        "last.response",
    )


def schedule_with_runs(latest: DataFrame, run_totals: DataFrame) -> DataFrame:
    """Latest schedules left-joined to last run time, run-row count and summed run
    seconds per (workspace, job), as ``run_totals`` gives them from the run events."""
    return latest.join(run_totals, ["job_id", "workspace_id"], "left").select(*LATEST_COLUMNS, *RUN_INFO_COLUMNS)
