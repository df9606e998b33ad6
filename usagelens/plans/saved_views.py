"""The five views as SQL text, kept in the catalog (logical views that outlive the session).

A catalog keeps a view as text, which a DataFrame doesn't have; here the text is composed from the names, keys and
fixed values that the operators use. ``create_views`` stores it with ``CREATE OR REPLACE VIEW``; any session on the
catalog then reads the view by name, planned against the tables as they are at that moment. The
rows equal those of :func:`~usagelens.plans.views.build_views` (tested).
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import SparkSession

from ..functions.time import seconds_sql
from ..operators import dashboards as D
from ..operators import metadata as M
from ..operators import metrics as Q
from ..operators import overlap as O
from ..operators import runs as R
from ..operators import schedules as S
from ..operators.cost import SERVERLESS_SQL_PATTERN, STATEMENT_KEYS
from ..schemas import JOB_RESULT_DDL, NEW_SETTINGS_DDL, QUERY_HISTORY, SCHEDULE_DDL, TASKS_DDL
from .history import ENHANCED_COLUMNS
from .views import DEFAULT_NAMES

#: The tables each view reads (the last view reads the second one).
VIEW_TABLES = {
    "enhanced_query_history": ("query_history", "usage", "list_prices"),
    "schedule_history": ("audit_log",),
    "schedule_latest": ("audit_log",),
    "run_history": ("audit_log",),
    "dashboard_history": ("audit_log", "query_history"),
}


def _text(value: object) -> str:
    """A string literal."""
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _in(values: Iterable[str]) -> str:
    return f"({', '.join(map(_text, values))})"


def _param(key: str) -> str:
    return f"request_params[{_text(key)}]"


def _parsed(text: str, ddl: str) -> str:
    return f"from_json({text}, {_text(ddl)})"


def _list(columns: Mapping[str, str] | Sequence[str]) -> str:
    """A select list of expressions by output name, or of plain columns."""
    pairs = columns.items() if isinstance(columns, Mapping) else ((c, c) for c in columns)
    return ",\n  ".join(e if e == n else f"{e} AS {n}" for n, e in pairs)


def _job_id() -> str:
    request = ", ".join(map(_param, S.JOB_ID_KEYS))
    return f"coalesce({_parsed('response.result', JOB_RESULT_DDL)}.job_id, {request})"


def schedule_history_sql(audit: str) -> str:
    """D11 over the audit table ``audit``."""
    read = {
        **{c: c for c in ("workspace_id", "event_time", "service_name", "action_name", "user_identity", "request_params", "response")},
        "job_id": _job_id(),
        "tasks": _parsed(_param(S.TASKS_KEY), TASKS_DDL),
        "schedule_info": _parsed(_param(S.SCHEDULE_KEY), SCHEDULE_DDL),
        "update_info": _parsed(_param(S.NEW_SETTINGS_KEY), NEW_SETTINGS_DDL),
        "job_name": _param(S.NAME_KEY),
        "from_redash_ind": _param(S.ORIGIN_KEY),
        "status": "response.status_code",
        "error": "response.error_message",
    }
    made = {c: f"coalesce(schedule_info.{f}, update_info.schedule.{f})" for c, f in (("schedule_cron", "quartz_cron_expression"), ("pause_status", "pause_status"))}
    made |= {f"{k}_id": f"get(tasks.sql_task.{k}.{k}_id, 0)" for k in ("alert", "dashboard", "query")}
    made["warehouse_id"] = "coalesce(get(update_info.tasks.sql_task.warehouse_id, 0), get(tasks.sql_task.warehouse_id, 0))"
    return f"""SELECT
  {_list({c: made.get(c, c) for c in S.CHANGE_COLUMNS})}
FROM (SELECT
  {_list(read)}
FROM {audit}
WHERE service_name = {_text(S.JOBS_SERVICE)} AND action_name IN {_in(S.CHANGE_ACTIONS)})"""


def schedule_latest_sql(changes: str) -> str:
    """D13 over the schedule history ``changes``: the newest rows of each job and role, then their product."""
    roles = {"newest": "true", "cron": "schedule_cron IS NOT NULL", "pause": "pause_status IS NOT NULL", "made": "schedule_info IS NOT NULL"}
    tags = ", ".join(f"CASE WHEN {cond} THEN {_text(r)} END" for r, cond in roles.items())
    whole = [c for c in S.CHANGE_COLUMNS if c != "job_id"]
    gathered = {f"{r}s": f"collect_list(CASE WHEN role = {_text(r)} THEN struct({', '.join(whole)}) END)" for r in roles}
    filled = {c: f"coalesce(newest.{c}, cron.{c}, made.{c})" for c in ("job_name", "dashboard_id", "alert_id", "query_id", "warehouse_id")}
    filled |= {
        "job_id": "job_id",
        "last_updated_time": "newest.event_time",
        "last_updated_action": "newest.action_name",
        "schedule_cron": "coalesce(newest.schedule_cron, cron.schedule_cron)",
        "pause_status": "coalesce(newest.pause_status, cron.pause_status, pause.pause_status)",
        "schedule_info": "coalesce(newest.schedule_info, cron.schedule_info, newest.update_info.schedule)",
    }
    views = " ".join(f"LATERAL VIEW explode({r}s) AS {r}" for r in roles)
    return f"""WITH tagged AS (
  SELECT *, explode(array_compact(array({tags}))) AS role FROM {changes} WHERE job_id IS NOT NULL
), ranked AS (
  SELECT *, dense_rank() OVER (PARTITION BY job_id, role ORDER BY event_time DESC NULLS LAST) AS place FROM tagged
), jobs AS (
  SELECT job_id, {_list(gathered)}
  FROM ranked
  WHERE place = 1 AND (role <> 'newest' OR (action_name <> {_text(S.DELETE_ACTION)} AND from_redash_ind = {_text(S.FLAGGED_ORIGIN)}))
  GROUP BY job_id
)
SELECT
  {_list({c: filled.get(c, f"newest.{c}") for c in S.LATEST_COLUMNS})}
FROM jobs {views}"""


def run_history_sql(audit: str, task_keys: Sequence[str] = R.SQL_TASK_KEYS) -> str:
    """D17 over the audit table ``audit``: events gathered by run, and the product of its triggers, starts and ends."""
    task = f"{_param(R.RUN_PARAMS['task_key'])} IN {_in(task_keys)}"
    role = (
        f"CASE WHEN action_name = {_text(R.TRIGGERED)} THEN 'trigger' WHEN action_name = {_text(R.STARTED)} AND {task} THEN 'start' "
        f"WHEN action_name IN {_in([R.SUCCEEDED, R.FAILED])} AND {task} THEN 'finish' END"
    )
    read = {
        **{c: c for c in ("workspace_id", "event_time", "service_name", "action_name", "request_params", "response")},
        "job_id": _job_id(),
        "main_run_id": f"coalesce({', '.join(map(_param, R.RUN_ID_KEYS))})",
        **{c: _param(k) for c, k in R.RUN_PARAMS.items() if c != "creator_name"},
        "role": role,
    }
    kept = [c for c in read if c not in ("job_id", "main_run_id", "role")]
    gathered = {f"{r}s": f"collect_list(CASE WHEN role = '{r}' THEN struct({', '.join(kept)}) END)" for r in ("trigger", "start", "finish")}
    made = {c: f"start.{c}" for c in ("task_type", "task_key", "query_id", "dashboard_id", "alert_id", "warehouse_id", "request_params")}
    made |= {c: f"trigger.{c}" for c in ("workspace_id", "service_name", "trigger_type")}
    made |= {
        "run_state": "coalesce(finish.action_name, trigger.action_name)",
        "job_id": "job_id",
        "main_run_id": "main_run_id",
        "triggered_event_time": "trigger.event_time",
        "run_event_time": "start.event_time",
        "run_end_event_time": "finish.event_time",
        "run_duration_seconds": "unix_timestamp(finish.event_time) - unix_timestamp(start.event_time)",
        "response": "finish.response",
        "status": "finish.response.status_code",
        "error": "finish.response.error_message",
    }
    return f"""WITH events AS (
  SELECT
  {_list(read)}
  FROM {audit} WHERE service_name = {_text(S.JOBS_SERVICE)} AND action_name IN {_in(R.RUN_ACTIONS)}
), named AS (
  -- what lacks a job or run id meets nothing: its triggers are spread, its starts and ends left out
  SELECT *, CASE WHEN job_id IS NULL OR main_run_id IS NULL THEN xxhash64(workspace_id, service_name, trigger_type, event_time) ELSE 0 END AS part
  FROM events WHERE role = 'trigger' OR (role IS NOT NULL AND job_id IS NOT NULL AND main_run_id IS NOT NULL)
), runs AS (
  SELECT job_id, main_run_id, {_list(gathered)}
  FROM named GROUP BY job_id, main_run_id, part
)
SELECT
  {_list({c: made[c] for c in R.RUN_HISTORY_COLUMNS})}
FROM runs LATERAL VIEW explode(triggers) AS trigger LATERAL VIEW OUTER explode(starts) AS start LATERAL VIEW OUTER explode(finishs) AS finish"""


def dashboard_history_sql(audit: str, history: str, since: str = D.PUBLISHED_SINCE, agent: str = D.SCHEDULED_AGENT_PATTERN) -> str:
    """D22 over the audit table and the query history."""
    made = {
        "workspace_id": "a.workspace_id",
        "dashboard_id": "a.dashboard_id",
        "request_id": "a.request_id",
        "statement_id": "h.statement_id",
        "mode": f"CASE WHEN a.user_agent ILIKE {_text(agent)} THEN {_text(D.SCHEDULED_MODE)} ELSE {_text(D.INTERACTIVE_MODE)} END",
        "user_owner": "coalesce(p.publisher, h.executed_by)",
        **{name: f"try_divide(h.{ms}, 1000)" for name, ms in D._SECONDS},
        **{f"{n}_date": f"CAST(h.{n}_time AS DATE)" for n in ("start", "end", "update")},
        "action_name": "a.action_name",
        "event_date": "a.event_date",
        **{f.name: f"h.{f.name}" for f in QUERY_HISTORY.fields if f.name not in D._REPLACED},
    }
    board = _param(D.DASHBOARD_KEY)
    return f"""WITH publishers AS (
  SELECT {board} AS dashboard_id, max_by(user_identity.email, struct(event_time, user_identity.email)) AS publisher
  FROM {audit} WHERE event_date >= DATE {_text(since)} AND action_name = {_text(D.PUBLISH_ACTION)}
  GROUP BY {board}
), executed AS (
  SELECT workspace_id, {board} AS dashboard_id, request_id, {_param(D.STATEMENT_KEY)} AS statement, user_agent, action_name, event_date
  FROM {audit} WHERE action_name = {_text(D.EXECUTE_ACTION)}
)
SELECT
  {_list(made)}
FROM executed AS a JOIN {history} AS h ON h.statement_id = a.statement LEFT JOIN publishers AS p ON p.dashboard_id = a.dashboard_id"""


def enhanced_history_sql(history: str, usage: str, prices: str, as_of: str | _dt.date | None = None, days: int = 15, sku_pattern: str = SERVERLESS_SQL_PATTERN) -> str:
    """Statements of the last ``days`` days with their cost; the window moves with the day of the query unless ``as_of`` is given."""
    day = "current_date()" if as_of is None else f"DATE {_text(as_of)}"
    since = f"date_sub({day}, {int(days)})"
    averages = {n: f"(SELECT avg({e}) FROM {history})" for n, e in Q.AVERAGED_SQL.items()}
    comment = "substr(statement_text, instr(statement_text, '/*') + 2, instr(statement_text, '*/') - instr(statement_text, '/*') - 2)"
    flags = Q.FLAGS_SQL
    tool = f"lower({M.COMMENT_MAP}['app']) = {_text(M.TOOL_APP)} OR client_application LIKE {_text(M.TOOL_CLIENT_PATTERN)}"
    made = {
        **flags,
        **averages,
        M.LABEL: f"CASE WHEN {tool} THEN {_text(M.TOOL_LABEL)} ELSE {_text(M.OTHER_LABEL)} END",
        **{k: f"{M.COMMENT_MAP}[{_text(k)}]" for k in M.COMMENT_KEYS},
        "node_or_connection": f"coalesce({M.COMMENT_MAP}['node_id'], {M.COMMENT_MAP}['connection_name'])",
    }
    keys = ", ".join(STATEMENT_KEYS)
    shared = f"{seconds_sql('greatest(start_time, usage_start_time)', 'least(end_time, usage_end_time)')}"
    return f"""WITH recent AS (
  SELECT * FROM {history} WHERE start_time >= {since}
), billed AS (
  SELECT usage_start_time, usage_end_time, sku_name, usage_metadata.warehouse_id AS warehouse_id, CAST(usage_quantity AS DOUBLE) AS quantity
  FROM {usage} WHERE usage_end_time > {since}
), spent AS (
  SELECT warehouse_id, usage_start_time, usage_end_time, CAST(pricing.default AS DOUBLE) * quantity AS spent_on_uptime
  FROM billed JOIN {prices} USING (sku_name) WHERE sku_name ILIKE {_text(sku_pattern)}
), used_spans AS (
  {O.spans_sql('spent', 'usage_start_time', 'usage_end_time')}
), run_spans AS (
  {O.spans_sql('(SELECT statement_id, workspace_id, compute.warehouse_id AS warehouse_id, start_time, end_time FROM recent)', 'start_time', 'end_time')}
), run_cells AS (
  {O.cells_sql('run_spans', 'used_spans', left=True)}
), used_cells AS (
  {O.cells_sql('used_spans', 'run_spans', left=False)}
), cost AS (
  SELECT {keys}, sum(coalesce({shared}, 0) * try_divide(spent_on_uptime, {seconds_sql('usage_start_time', 'usage_end_time')})) AS approx_query_cost
  FROM (SELECT r.* EXCEPT (first_bin), u.* EXCEPT (warehouse_id, cell, first_bin), r.first_bin AS run_first, u.first_bin AS used_first
        FROM run_cells AS r JOIN used_cells AS u ON r.warehouse_id = u.warehouse_id AND r.cell = u.cell)
  WHERE start_time < usage_end_time AND end_time > usage_start_time AND {O.owner_sql('cell', 'run_first', 'used_first')}
  GROUP BY {keys}
), measured AS (
  SELECT {_list(Q.METRICS_SQL)}, {comment} AS {M.COMMENT_TEXT}
  FROM recent
), told AS (
  SELECT m.*, c.approx_query_cost, from_json({M.COMMENT_TEXT}, 'map<string,string>') AS {M.COMMENT_MAP}
  FROM measured AS m JOIN (SELECT workspace_id, statement_id, approx_query_cost FROM cost) AS c USING (workspace_id, statement_id)
)
SELECT
  {_list({c: made.get(c, c) for c in ENHANCED_COLUMNS})}
FROM told"""


def view_texts(tables: Mapping[str, str], names: Mapping[str, str] | None = None, as_of: str | _dt.date | None = None) -> dict[str, str]:
    """SQL text of each view whose tables ``tables`` names (logical source name to table)."""
    names = {**DEFAULT_NAMES, **(names or {})}
    has = {v for v, needs in VIEW_TABLES.items() if set(needs) <= set(tables)}
    made = {
        "schedule_history": lambda: schedule_history_sql(tables["audit_log"]),
        "schedule_latest": lambda: schedule_latest_sql(names["schedule_history"]),
        "run_history": lambda: run_history_sql(tables["audit_log"]),
        "dashboard_history": lambda: dashboard_history_sql(tables["audit_log"], tables["query_history"]),
        "enhanced_query_history": lambda: enhanced_history_sql(tables["query_history"], tables["usage"], tables["list_prices"], as_of),
    }
    return {v: text() for v, text in made.items() if v in has}


def create_views(spark: SparkSession, tables: Mapping[str, str], names: Mapping[str, str] | None = None, as_of: str | _dt.date | None = None) -> dict[str, str]:
    """Create (or replace) the views in the catalog and return logical name -> view name.

    ``tables`` gives the catalog table of each source, ``names`` the views' names (one to three parts). A view is left out if
    a table it reads isn't named. Temporary views can't be read by a catalog view, so every source is a table.
    """
    names = {**DEFAULT_NAMES, **(names or {})}
    texts = view_texts(tables, names, as_of)
    for logical, text in texts.items():
        spark.sql(f"CREATE OR REPLACE VIEW {names[logical]} AS\n{text}")
    return {v: names[v] for v in texts}
