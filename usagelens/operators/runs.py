"""Run histories: timeline statistics (D15), run events from the audit log (D16),
run history (D17) and run statistics (D18)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import epoch_seconds_between, param
from .schedules import JOBS_SERVICE, job_id_of_event

# Task keys of SQL-asset tasks, and the run lifecycle actions.
SQL_TASK_KEYS = ["refresh-dashboard", "refresh-alert", "refresh-query", "sqlalert", "sqldashboard", "sqlsavedquery"]
TRIGGERED = "runTriggered"
STARTED = "runStart"
SUCCEEDED = "runSucceeded"
FAILED = "runFailed"
RUN_ACTIONS = [TRIGGERED, FAILED, STARTED, SUCCEEDED]
# Request-parameter keys of run events (output column -> key).
RUN_ID_KEYS = ["multitaskParentRunId", "runId"]
RUN_PARAMS = {
    "task_type": "jobTaskType",
    "task_key": "taskKey",
    "trigger_type": "jobTriggerType",
    "query_id": "queryIds",
    "dashboard_id": "dashboardId",
    "alert_id": "alertId",
    "warehouse_id": "warehouseId",
    "creator_name": "runCreatorUserName",
}

RUN_HISTORY_COLUMNS = [
    "workspace_id", "service_name", "run_state", "job_id", "main_run_id", "trigger_type",
    "triggered_event_time", "run_event_time", "run_end_event_time", "run_duration_seconds",
    "task_type", "task_key", "query_id", "dashboard_id", "alert_id", "warehouse_id",
    "request_params", "response", "status", "error",
]


def timeline_run_stats(
    timeline: DataFrame, task_keys: Sequence[str] = SQL_TASK_KEYS, sort: bool = True
) -> DataFrame:
    """Distinct runs and summed run seconds per (workspace, job, task, state, warehouse set),
    longest total first.

    The last key is ``array_distinct(compute_ids)``: first occurrences in their order, so
    ``[a, b]`` and ``[b, a]`` are two groups.
    """
    out = (
        timeline.where(F.col("task_key").isin(list(task_keys)))
        .groupBy(
            "workspace_id", "job_id", "task_key", "result_state",
            F.array_distinct("compute_ids").alias("warehouses"),
        )
        .agg(
            F.count_distinct("run_id").alias("total_num_runs"),
            F.sum(epoch_seconds_between("period_start_time", "period_end_time")).alias("total_run_duration_seconds"),
        )
        .select(
            "workspace_id", "job_id", "task_key", "result_state",
            "total_num_runs", "total_run_duration_seconds", "warehouses",
        )
    )
    # group keys break ties (e.g. many NULL totals), so a hot value does not sit in one sort task
    ties = ["workspace_id", "job_id", "task_key", "result_state"]
    return out.orderBy(F.desc("total_run_duration_seconds"), *ties) if sort else out


def run_events(audit: DataFrame) -> DataFrame:
    """The four run actions of the jobs service, normalised.

    The run id of a task event is its parent run id, so task starts and ends meet the
    trigger of their run.
    """
    return audit.where(
        (F.col("service_name") == JOBS_SERVICE) & F.col("action_name").isin(RUN_ACTIONS)
    ).select(
        "workspace_id",
        "event_time",
        "service_name",
        "action_name",
        job_id_of_event().alias("job_id"),
        F.coalesce(*[param(k) for k in RUN_ID_KEYS]).alias("main_run_id"),
        *[param(key).alias(name) for name, key in RUN_PARAMS.items()],
        "request_params",
        "response",
        F.col("response.status_code").alias("status"),
        F.col("response.error_message").alias("error"),
    )


_RUN = ["job_id", "main_run_id"]


def _run_roles(events: DataFrame, task_keys: Sequence[str]) -> DataFrame:
    """Run events with their role in a run history: trigger, start or end (other events are left out)."""
    sql_task = F.col("task_key").isin(list(task_keys))
    role = (
        F.when(F.col("action_name") == TRIGGERED, "trigger")
        .when((F.col("action_name") == STARTED) & sql_task, "start")
        .when(F.col("action_name").isin(SUCCEEDED, FAILED) & sql_task, "end")
    )
    return events.withColumn("_role", role).where(F.col("_role").isNotNull()).withColumn("_sec", F.unix_timestamp("event_time"))


def _is_named():
    return F.col("job_id").isNotNull() & F.col("main_run_id").isNotNull()  # NULL keys meet nothing


def _list_of(role: str, *cols):
    return F.collect_list(F.when(F.col("_role") == role, F.struct(*cols)))


def run_history(events: DataFrame, task_keys: Sequence[str] = SQL_TASK_KEYS, cuts: int = 1) -> DataFrame:
    """Every trigger, left-joined to task starts and task ends of its run.

    As in the reports, starts and ends meet on (job, run) only, not on the task: a run
    with k matching tasks yields k starts x k ends rows, bounded by the job's task count.
    State is the end action, else the trigger action; duration is the epoch-second
    difference of end and start.

    The events are read once and gathered by run, and the product is exploded from the gathered
    lists: one scan, one shuffle. A run's lists hold its task events, at most as many as the rows it
    gives. Parameters and responses have lists of their own, in step with those of the starts and ends (one
    aggregate fills both from the same rows), so that a reader that doesn't ask for them doesn't shuffle them. ``cuts`` splits the triggers of each run over that many groups, to each of which the run's starts and
    ends are sent, for logs in which one run is triggered very often. Triggers without a job or run id
    meet nothing; they are spread by their content instead of gathered.
    """
    tagged = _run_roles(events, task_keys).where(_is_named() | (F.col("_role") == "trigger"))
    spread = F.xxhash64("workspace_id", "service_name", "trigger_type", "event_time")
    part = F.pmod(spread, F.lit(cuts))
    if cuts == 1:
        tagged = tagged.withColumn("_part", F.when(_is_named(), F.lit(0).cast("long")).otherwise(spread))
    else:
        everywhere = F.sequence(F.lit(0).cast("long"), F.lit(cuts - 1).cast("long"))
        parts = F.when(~_is_named(), F.array(spread)).when(F.col("_role") == "trigger", F.array(part)).otherwise(everywhere)
        tagged = tagged.withColumn("_part", F.explode(parts))
    runs = tagged.groupBy(*_RUN, "_part").agg(
        _list_of("trigger", "workspace_id", "service_name", "action_name", "trigger_type", "event_time").alias("_triggers"),
        _list_of("start", "event_time", "task_type", "task_key", "query_id", "dashboard_id", "alert_id", "warehouse_id").alias("_starts"),
        _list_of("start", "request_params").alias("_params"),
        _list_of("end", "event_time", "action_name", "status", "error").alias("_ends"),
        _list_of("end", "response").alias("_responses"),
    )
    met = (
        runs.select("*", F.explode("_triggers").alias("t"))
        .select("*", F.posexplode_outer("_starts").alias("_s_at", "s"))
        .select("*", F.posexplode_outer("_ends").alias("_e_at", "e"))
    )
    return met.select(
        "t.workspace_id",
        "t.service_name",
        F.coalesce("e.action_name", "t.action_name").alias("run_state"),
        *_RUN,
        "t.trigger_type",
        F.col("t.event_time").alias("triggered_event_time"),
        F.col("s.event_time").alias("run_event_time"),
        F.col("e.event_time").alias("run_end_event_time"),
        epoch_seconds_between(F.col("s.event_time"), F.col("e.event_time")).alias("run_duration_seconds"),
        "s.task_type", "s.task_key", "s.query_id", "s.dashboard_id", "s.alert_id", "s.warehouse_id",
        F.get("_params", F.col("_s_at"))["request_params"].alias("request_params"),
        F.get("_responses", F.col("_e_at"))["response"].alias("response"), "e.status", "e.error",
    )


RUN_STAT_KEYS = ["workspace_id", "job_id", "task_key", "run_state", "query_id", "dashboard_id", "alert_id"]


def run_totals(events: DataFrame, task_keys: Sequence[str] = SQL_TASK_KEYS) -> DataFrame:
    """Last trigger time, run-history rows with a run id, and summed run seconds per (workspace, job).

    Equals grouping :func:`run_history` without its pairs: a trigger of a run with S starts and
    E ends stands for max(S, 1) * max(E, 1) rows, whose seconds add up to S' * sum(ends) - E' *
    sum(starts), S' and E' counting those with a time (NULL if either is 0). Events are read
    once and summed by run before the first shuffle; the window sees a row per workspace.
    """
    when = {r: F.col("_role") == r for r in ("trigger", "start", "end")}

    def of(role, column):
        return F.when(when[role], column)

    cells = (
        _run_roles(events, task_keys)
        .groupBy(*_RUN, of("trigger", F.col("workspace_id")).alias("workspace_id"), when["trigger"].alias("_is_trigger"))
        .agg(
            F.count(of("trigger", F.lit(1))).alias("_t"), F.max(of("trigger", F.col("event_time"))).alias("_last"),
            F.count(of("start", F.lit(1))).alias("_s"), F.count(of("start", F.col("_sec"))).alias("_s_timed"),
            F.sum(of("start", F.col("_sec"))).alias("_s_sum"), F.count(of("end", F.lit(1))).alias("_e"),
            F.count(of("end", F.col("_sec"))).alias("_e_timed"), F.sum(of("end", F.col("_sec"))).alias("_e_sum"),
        )
    )
    run = Window.partitionBy(*_RUN)

    def whole(c):
        return F.when(_is_named(), F.sum(c).over(run))

    rows = cells.select(
        "job_id", "main_run_id", "workspace_id", "_is_trigger", "_t", "_last",
        *[whole(c).alias(c) for c in ("_s", "_s_timed", "_s_sum", "_e", "_e_timed", "_e_sum")],
    ).where("_is_trigger")
    n = F.col("_t") * F.greatest(F.col("_s"), F.lit(1)) * F.greatest(F.col("_e"), F.lit(1))
    seconds = F.when(
        (F.col("_s_timed") > 0) & (F.col("_e_timed") > 0),
        F.col("_t") * (F.col("_s_timed") * F.col("_e_sum") - F.col("_e_timed") * F.col("_s_sum")),
    )
    return rows.groupBy("workspace_id", "job_id").agg(
        F.max("_last").alias("last_run_time"),
        F.coalesce(F.sum(F.when(F.col("main_run_id").isNotNull(), F.coalesce(n, F.col("_t")))), F.lit(0)).alias("total_num_runs"),
        F.sum(seconds).alias("total_run_duration_seconds"),
    )


def run_stats(events: DataFrame, task_keys: Sequence[str] = SQL_TASK_KEYS, sort: bool = True) -> DataFrame:
    """Distinct runs, summed run seconds and the set of warehouses per
    (workspace, job, task, state, query, dashboard, alert), longest total first.

    Equals grouping :func:`run_history` without its pairs, from one scan: events are first counted and summed
    by run and by what the report keeps of them (a trigger's workspace, a start's task, asset and
    warehouse, an end's action); a run's few cells then meet as pairs do, in a window over the run: each start's
    cell gets the run's trigger cells and the sums of its ends. As a start's cell has one
    warehouse, the warehouses of a group are gathered value by value, so that its state is as large as the
    set, whatever the number of runs or of different sets in them.
    """
    start, end = F.col("_role") == "start", F.col("_role") == "end"
    task = ["task_key", "query_id", "dashboard_id", "alert_id", "warehouse_id"]
    cells = (
        _run_roles(events, task_keys)
        .where(_is_named() | (F.col("_role") == "trigger"))
        .groupBy(
            *_RUN, "_role", F.when(F.col("_role") == "trigger", F.col("workspace_id")).alias("workspace_id"),
            F.when(end, F.col("action_name")).alias("action_name"), *[F.when(start, F.col(c)).alias(c) for c in task],
        )
        .agg(F.count(F.lit(1)).alias("_n"), F.count("_sec").alias("_timed"), F.sum("_sec").alias("_sum"))
    )
    run = Window.partitionBy(*_RUN)

    def ends_of(action):
        mine = end & (F.col("action_name") == action)
        return F.struct(*[F.sum(F.when(mine, F.col(c))).over(run).alias(c) for c in ("_n", "_timed", "_sum")]).alias(action)

    asked = F.when((F.col("_role") == "trigger") & _is_named(), F.struct("workspace_id", "_n"))
    met = cells.select(
        *_RUN, "_role", "workspace_id", "_n", "_timed", "_sum", *task, F.collect_list(asked).over(run).alias("_triggers"),
        F.max(start).over(run).alias("_has_start"), ends_of(SUCCEEDED), ends_of(FAILED),
    ).where(start | ((F.col("_role") == "trigger") & ~F.col("_has_start")))
    # a run's ends have two actions; one without ends meets a row of NULLs
    no_end = F.col(f"{SUCCEEDED}._n").isNull() & F.col(f"{FAILED}._n").isNull()
    ends = F.array(
        *[F.struct(F.lit(a).alias("action_name"), F.col(f"{a}._n").isNotNull().alias("is_one"), F.col(f"{a}._timed").alias("_timed"), F.col(f"{a}._sum").alias("_sum")) for a in (SUCCEEDED, FAILED)],
        F.struct(F.lit(None).cast("string").alias("action_name"), no_end.alias("is_one"), F.lit(None).cast("long").alias("_timed"), F.lit(None).cast("long").alias("_sum")),
    )
    triggers = F.when(start, F.col("_triggers")).otherwise(F.array(F.struct("workspace_id", "_n")))
    met = (
        met.select(*_RUN, *task, F.when(start, F.struct("_timed", "_sum")).alias("s"), F.explode(triggers).alias("t"), ends.alias("_ends"))
        .select(*_RUN, *task, "s", "t", F.explode("_ends").alias("e"))
        .where("e.is_one")
    )
    seconds = F.when(
        (F.col("s._timed") > 0) & (F.col("e._timed") > 0),
        F.col("t._n") * (F.col("s._timed") * F.col("e._sum") - F.col("e._timed") * F.col("s._sum")),
    )
    # a run counts once in a group: its rows stand in one task already, so no shuffle and no distinct aggregate
    once = Window.partitionBy(*RUN_STAT_KEYS, "main_run_id").orderBy("warehouse_id")
    out = (
        met.select(
            *_RUN, "t.workspace_id", *task,
            F.coalesce("e.action_name", F.lit(TRIGGERED)).alias("run_state"), seconds.alias("_seconds"),
        )
        .withColumn("_first", (F.row_number().over(once) == 1) & F.col("main_run_id").isNotNull())
        .groupBy(*RUN_STAT_KEYS)
        .agg(
            F.count(F.when(F.col("_first"), F.lit(1))).alias("total_num_runs"),
            F.sum("_seconds").alias("total_run_duration_seconds"),
            F.collect_set("warehouse_id").alias("warehouses"),
        )
    )
    return out.orderBy(F.desc("total_run_duration_seconds"), *RUN_STAT_KEYS) if sort else out
