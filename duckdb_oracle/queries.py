"""DuckDB oracle SQL for every checkable query (same output names as the Spark side).

Written as plain relational SQL in its own terms: whole-history averages are a one-row
aggregate, statement cost groups the overlap pairs directly, the latest schedule uses
per-role newest times, and every join is explicit. Doubles are rounded to 6 places the
same way as on the Spark side.
"""

from __future__ import annotations

from .fixtures import AUDIT, LIST_PRICES, QUERY_HISTORY, TIMELINE, USAGE, WAREHOUSE_EVENTS

BOUND_15 = "DATE '2024-01-31' - INTERVAL 15 DAY"
BOUND_10 = "DATE '2024-01-31' - INTERVAL 10 DAY"
DETAIL_NODE = "model.p.view"
ONE_DASHBOARD = "d3"
SQL_TASK_KEYS = "('refresh-dashboard', 'refresh-alert', 'refresh-query', 'sqlalert', 'sqldashboard', 'sqlsavedquery')"

DOUBLES = {
    "QueryRuntimeSeconds", "CPUTotalExecutionTime", "ExecutionQueryTime", "CompilationQueryTime", "QueueQueryTime",
    "StartUpQueryTime", "ResultFetchTime", "TotalResourceTimeUsedForAllocation",
    "TotalCPUTime_To_Execution_Time_Ratio", "ProportionQueueTime", "WarehouseAvgQueryRuntime",
    "WarehouseAvgQueueTime", "WarehouseAvgProportionTimeQueueing", "ReadDataAmountInGB", "Calc_ReadDataFlag",
    "Calc_UsedWorkerTasksFlag", "approx_query_cost", "apprx_query_cost", "cost_per_second", "sku_price",
    "usage_quantity", "total_cost_for_warehouse_uptime",
}

METRICS = [
    "workspace_id", "statement_id", "executed_by", "statement_text", "warehouse_id", "execution_status",
    "statement_type", "client_application", "error_message", "QueryRuntimeSeconds", "CPUTotalExecutionTime",
    "ExecutionQueryTime", "CompilationQueryTime", "QueueQueryTime", "StartUpQueryTime", "ResultFetchTime",
    "TotalResourceTimeUsedForAllocation", "start_time", "end_time", "update_time", "read_bytes",
    "read_io_cache_percent", "from_result_cache", "spilled_local_bytes", "TotalCPUTime_To_Execution_Time_Ratio",
    "ProportionQueueTime",
]
AVERAGES = ["WarehouseAvgQueryRuntime", "WarehouseAvgQueueTime", "WarehouseAvgProportionTimeQueueing"]
FLAGS = [
    "ReadDataAmountInGB", "UsedCacheFlag", "HasSpillFlag", "ReadDataFlag", "UsedWorkerTasksFlag",
    "Calc_HasSpillFlag", "Calc_ReadDataFlag", "Calc_UsedWorkerTasksFlag",
]
COMMENT_KEYS = ["app", "node_id", "profile_name", "target_name", "connection_name", "dbt_version", "dbt_databricks_version"]
META = ["DBT_Query_Type", *COMMENT_KEYS, "node_or_connection"]
TOOL = [*METRICS, *AVERAGES, *FLAGS, "dbt_metadata_json", *META]


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


def _once(cte: str) -> str:
    """The CTE computed once, however often it is read."""
    return cte.replace(" AS (", " AS MATERIALIZED (", 1)


def _rd(expr: str) -> str:
    """Round to 6 places like the Spark side: snap to 9 places, then exact half-up on the decimal."""
    return f"CAST(round(CAST(round({expr}, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE)"


def _cols(alias: str, names: list[str]) -> str:
    """Select list with doubles rounded."""
    out = []
    for n in names:
        ref = f"{alias}.{n}" if alias else n
        out.append(f"{_rd(ref)} AS {n}" if n in DOUBLES else ref)
    return ", ".join(out)


def _sec(col: str) -> str:
    return f"coalesce(CAST(h.{col} AS DOUBLE) / 1000, 0)"


# --- statements --------------------------------------------------------------------

STMT = f"""
stmt AS (
  SELECT
    h.workspace_id, h.statement_id, h.executed_by, h.statement_text, h.warehouse_id, h.execution_status,
    h.statement_type, h.client_application,
    coalesce(h.error_message, 'None') AS error_message,
    {_sec('total_duration_ms')} AS QueryRuntimeSeconds,
    {_sec('total_task_duration_ms')} AS CPUTotalExecutionTime,
    {_sec('execution_duration_ms')} AS ExecutionQueryTime,
    {_sec('compilation_duration_ms')} AS CompilationQueryTime,
    {_sec('waiting_at_capacity_duration_ms')} AS QueueQueryTime,
    {_sec('waiting_for_compute_duration_ms')} AS StartUpQueryTime,
    {_sec('result_fetch_duration_ms')} AS ResultFetchTime,
    CASE WHEN {_sec('total_task_duration_ms')} = 0 THEN 0.0
         ELSE {_sec('total_duration_ms')} + {_sec('compilation_duration_ms')} END AS TotalResourceTimeUsedForAllocation,
    h.start_time, h.end_time, h.update_time,
    coalesce(h.read_bytes, 0) AS read_bytes,
    coalesce(h.read_io_cache_percent, 0) AS read_io_cache_percent,
    h.from_result_cache,
    coalesce(h.spilled_local_bytes, 0) AS spilled_local_bytes,
    CASE WHEN h.total_duration_ms <> 0
         THEN CAST(h.total_task_duration_ms AS DOUBLE) / h.total_duration_ms END AS TotalCPUTime_To_Execution_Time_Ratio,
    CASE WHEN h.total_duration_ms <> 0 AND h.waiting_at_capacity_duration_ms IS NOT NULL
         THEN CAST(h.waiting_at_capacity_duration_ms AS DOUBLE) / h.total_duration_ms ELSE 0.0 END AS ProportionQueueTime,
    CASE WHEN h.read_bytes > 0 THEN CAST(h.read_bytes AS DOUBLE) / 1073741824 ELSE 0.0 END AS ReadDataAmountInGB,
    CASE WHEN h.read_io_cache_percent > 0 THEN 'Used Cache' ELSE 'No Cache' END AS UsedCacheFlag,
    CASE WHEN h.spilled_local_bytes > 0 THEN 'Spilled Data To Disk' ELSE 'No Spill' END AS HasSpillFlag,
    CASE WHEN h.read_bytes > 0 THEN 'Did Read Data' ELSE 'No Data Read' END AS ReadDataFlag,
    CASE WHEN coalesce(h.total_task_duration_ms, 0) > 0 THEN 'UsedWorkerTasks' ELSE 'NoWorkers' END AS UsedWorkerTasksFlag,
    CASE WHEN h.spilled_local_bytes > 0 THEN 1 ELSE 0 END AS Calc_HasSpillFlag,
    CASE WHEN h.read_bytes > 0 THEN 0.25 ELSE 0.0 END AS Calc_ReadDataFlag,
    CASE WHEN coalesce(h.total_task_duration_ms, 0) > 0 THEN 0.25 ELSE 0.0 END AS Calc_UsedWorkerTasksFlag,
    CASE WHEN h.statement_text IS NULL THEN NULL
         WHEN strpos(h.statement_text, '*/') - strpos(h.statement_text, '/*') > 2
         THEN substring(h.statement_text, strpos(h.statement_text, '/*') + 2,
                        strpos(h.statement_text, '*/') - strpos(h.statement_text, '/*') - 2)
         ELSE '' END AS dbt_metadata_json
  FROM qh h
)"""


def _fleet(by_warehouse: bool = False) -> str:
    share = (
        "CASE WHEN total_duration_ms <> 0 AND waiting_at_capacity_duration_ms IS NOT NULL "
        "THEN (CAST(waiting_at_capacity_duration_ms AS DOUBLE) / 1000) / (CAST(total_duration_ms AS DOUBLE) / 1000) "
        "ELSE 0.0 END"
    )
    key = "warehouse_id, " if by_warehouse else ""
    group = " GROUP BY warehouse_id" if by_warehouse else ""
    return f"""
fleet AS (
  SELECT {key}
    avg(CAST(total_duration_ms AS DOUBLE) / 1000) AS WarehouseAvgQueryRuntime,
    avg(CAST(waiting_at_capacity_duration_ms AS DOUBLE) / 1000) AS WarehouseAvgQueueTime,
    avg({share}) AS WarehouseAvgProportionTimeQueueing
  FROM qh{group}
)"""


def _meta(missing: str = "NULL") -> str:
    keys = ",\n    ".join(f"coalesce(json_extract_string(doc, '$.{k}'), {missing}) AS {k}" for k in COMMENT_KEYS)
    return f"""
meta AS (
  SELECT s.* EXCLUDE (doc),
    CASE WHEN lower(json_extract_string(doc, '$.app')) = 'dbt' OR s.client_application LIKE '%dbt%'
         THEN 'DBT Query' ELSE 'Other Query Type' END AS DBT_Query_Type,
    {keys},
    coalesce(json_extract_string(doc, '$.node_id'), json_extract_string(doc, '$.connection_name'), {missing})
      AS node_or_connection
  FROM (SELECT *, try_cast(dbt_metadata_json AS JSON) AS doc FROM stmt) s
)"""


BILLING = """
billed AS (
  SELECT u.usage_start_time, u.usage_end_time, p.sku_name, p.price AS sku_price, u.usage_date, u.usage_quantity,
         u.warehouse_id, p.price * u.usage_quantity AS total_cost_for_warehouse_uptime,
         date_sub('second', u.usage_start_time, u.usage_end_time) AS billed_seconds
  FROM usage u JOIN list_prices p ON p.sku_name = u.sku_name
  WHERE lower(p.sku_name) LIKE '%serverless%sql%'
),
pairs AS (
  SELECT h.statement_id, h.workspace_id, h.warehouse_id, h.start_time, h.end_time, b.usage_start_time, b.usage_end_time,
         coalesce(date_sub('second', greatest(h.start_time, b.usage_start_time), least(h.end_time, b.usage_end_time)), 0)
           AS query_duration_in_interval,
         CASE WHEN b.billed_seconds <> 0 THEN b.total_cost_for_warehouse_uptime / b.billed_seconds END AS cost_per_second
  FROM qh h JOIN billed b
    ON b.warehouse_id = h.warehouse_id AND h.start_time < b.usage_end_time AND b.usage_start_time < h.end_time
),
stmt_cost AS (
  SELECT statement_id, workspace_id, warehouse_id, start_time, end_time,
         sum(query_duration_in_interval * cost_per_second) AS approx_query_cost
  FROM pairs
  GROUP BY statement_id, workspace_id, warehouse_id, start_time, end_time
)"""

SQL: dict[str, str] = {}

SQL["statement_metrics"] = _with(QUERY_HISTORY, STMT) + f"SELECT {_cols('', [*METRICS, 'ReadDataAmountInGB'])} FROM stmt"

SQL["statement_flags"] = _with(QUERY_HISTORY, STMT) + f"SELECT {_cols('', ['statement_id', *FLAGS])} FROM stmt"

SQL["fleet_averages"] = _with(QUERY_HISTORY, STMT, _fleet()) + (
    f"SELECT {_cols('s', ['statement_id', 'QueryRuntimeSeconds'])}, {_cols('f', AVERAGES)} FROM stmt s CROSS JOIN fleet f"
)

SQL["fleet_averages_by_warehouse"] = _with(QUERY_HISTORY, STMT, _fleet(by_warehouse=True)) + (
    f"SELECT {_cols('s', ['statement_id', 'warehouse_id'])}, {_cols('f', AVERAGES)} "
    "FROM stmt s LEFT JOIN fleet f ON f.warehouse_id = s.warehouse_id"
)

_COMMENT = ["statement_id", "dbt_metadata_json", *COMMENT_KEYS, "node_or_connection"]
SQL["comment_metadata"] = _with(QUERY_HISTORY, STMT, _meta()) + f"SELECT {_cols('', _COMMENT)} FROM meta"
SQL["comment_metadata_filled"] = _with(QUERY_HISTORY, STMT, _meta("'None'")) + f"SELECT {_cols('', _COMMENT)} FROM meta"
SQL["client_label"] = _with(QUERY_HISTORY, STMT, _meta()) + "SELECT statement_id, client_application, DBT_Query_Type FROM meta"

_COST_BASE = _with(QUERY_HISTORY, USAGE, LIST_PRICES, BILLING)

SQL["priced_usage"] = _COST_BASE + "SELECT " + _cols("", [
    "usage_start_time", "usage_end_time", "sku_name", "sku_price", "usage_date", "usage_quantity", "warehouse_id",
    "total_cost_for_warehouse_uptime",
]) + " FROM billed"

SQL["interval_overlap"] = _COST_BASE + (
    "SELECT statement_id, warehouse_id, start_time, end_time, usage_start_time, usage_end_time FROM pairs"
)

SQL["allocate_cost"] = _COST_BASE + "SELECT " + _cols("", [
    "statement_id", "warehouse_id", "usage_start_time", "query_duration_in_interval", "cost_per_second",
]) + " FROM pairs"

SQL["statement_cost"] = _COST_BASE + "SELECT " + _cols("", [
    "statement_id", "workspace_id", "warehouse_id", "start_time", "end_time", "approx_query_cost",
]) + " FROM stmt_cost"

SQL["elapsed_vs_epoch_seconds"] = _with(QUERY_HISTORY) + (
    "SELECT statement_id, date_sub('second', start_time, end_time) AS elapsed_seconds, "
    "date_diff('second', start_time, end_time) AS epoch_seconds FROM qh"
)

SQL["enhanced_history"] = _with(QUERY_HISTORY, USAGE, LIST_PRICES, STMT, _fleet(), _meta(), BILLING) + f"""
SELECT {_cols('m', [c for c in TOOL if c not in AVERAGES])}, {_cols('f', AVERAGES)},
       {_rd('c.approx_query_cost')} AS approx_query_cost
FROM meta m
CROSS JOIN fleet f
JOIN stmt_cost c ON c.workspace_id = m.workspace_id AND c.statement_id = m.statement_id
WHERE m.start_time >= {BOUND_15}"""


def _tool_cost(min_runtime: int) -> str:
    base = _with(QUERY_HISTORY, USAGE, LIST_PRICES, STMT, _fleet(), _meta("'None'"), BILLING)
    return base + f""",
tool_cost AS (
  SELECT m.*, f.*, c.approx_query_cost AS apprx_query_cost, h.total_task_duration_ms
  FROM meta m
  CROSS JOIN fleet f
  JOIN stmt_cost c ON c.workspace_id = m.workspace_id AND c.statement_id = m.statement_id AND c.start_time >= {BOUND_10}
  JOIN qh h ON h.statement_id = c.statement_id AND h.start_time >= {BOUND_10}
  WHERE m.DBT_Query_Type = 'DBT Query' AND m.QueryRuntimeSeconds > {min_runtime} AND m.start_time >= {BOUND_10}
)
"""


SQL["node_cost_report"] = _tool_cost(60) + f"""
SELECT workspace_id, profile_name, target_name, node_or_connection,
       count(*) AS num_runs,
       {_rd('sum(CPUTotalExecutionTime)')} AS sum_CPUTotalExecutionTime,
       {_rd('sum(QueryRuntimeSeconds)')} AS sum_QueryRuntimeSeconds,
       min(statement_id) AS example_statement_id,
       {_rd('sum(apprx_query_cost)')} AS sum_apprx_query_cost,
       {_rd('avg(apprx_query_cost)')} AS avg_apprx_query_cost,
       {_rd('quantile_cont(apprx_query_cost, 0.5)')} AS med_apprx_query_cost
FROM tool_cost
GROUP BY workspace_id, profile_name, target_name, node_or_connection"""

SQL["enhanced_history_order"] = f"""
SELECT workspace_id, statement_id, approx_query_cost,
       row_number() OVER (ORDER BY approx_query_cost DESC NULLS LAST, workspace_id NULLS FIRST, statement_id NULLS FIRST) AS position
FROM ({SQL["enhanced_history"]})"""

SQL["node_cost_order"] = f"""
SELECT workspace_id, profile_name, target_name, node_or_connection, num_runs, sum_CPUTotalExecutionTime,
       row_number() OVER (ORDER BY sum_CPUTotalExecutionTime DESC NULLS LAST, workspace_id NULLS FIRST, profile_name NULLS FIRST,
                          target_name NULLS FIRST, node_or_connection NULLS FIRST) AS position
FROM ({SQL["node_cost_report"]})"""

SQL["node_cost_detail"] = _tool_cost(1) + f"""
SELECT {_cols('', [*TOOL, 'apprx_query_cost', 'total_task_duration_ms'])}
FROM tool_cost
WHERE node_or_connection = '{DETAIL_NODE}'"""

# --- audit log: schedules --------------------------------------------------------------

_SCHEDULE_T = """'{"quartz_cron_expression":"VARCHAR","timezone_id":"VARCHAR","pause_status":"VARCHAR"}'"""
_NEW_SETTINGS_T = (
    """'{"schedule":{"quartz_cron_expression":"VARCHAR","timezone_id":"VARCHAR","pause_status":"VARCHAR"},"""
    """"tasks":[{"task_key":"VARCHAR","sql_task":{"dashboard":{"dashboard_id":"VARCHAR","pause_subscriptions":"BOOLEAN"},"""
    """"warehouse_id":"VARCHAR"}}]}'"""
)

CHANGES = f"""
job_events AS (
  SELECT workspace_id, event_time, service_name, action_name, email AS user_email,
    coalesce(json_extract_string(result, '$.job_id'), p_job_id, p_jobId) AS job_id,
    p_tasks,
    json_transform(p_schedule, {_SCHEDULE_T}) AS schedule_info,
    json_transform(p_new_settings, {_NEW_SETTINGS_T}) AS update_info,
    p_name AS job_name, p_is_from_redash AS from_redash_ind, status_code AS status, error_message AS error,
    p_name AS param_name, p_job_id AS param_job_id, p_jobId AS param_job_id_2, result AS response_result,
    ((p_name IS NOT NULL)::BIGINT + (p_is_from_redash IS NOT NULL)::BIGINT + (p_tasks IS NOT NULL)::BIGINT + (p_schedule IS NOT NULL)::BIGINT + (p_job_id IS NOT NULL)::BIGINT + (p_new_settings IS NOT NULL)::BIGINT + (p_jobId IS NOT NULL)::BIGINT) AS n_params
  FROM audit
  WHERE service_name = 'jobs' AND action_name IN ('create', 'update', 'delete')
),
changes AS (
  SELECT workspace_id, event_time, service_name, action_name, user_email,
    coalesce(schedule_info.quartz_cron_expression, update_info.schedule.quartz_cron_expression) AS schedule_cron,
    schedule_info,
    coalesce(schedule_info.pause_status, update_info.schedule.pause_status) AS pause_status,
    status, from_redash_ind, job_id, job_name,
    json_extract_string(p_tasks, '$[0].sql_task.alert.alert_id') AS alert_id,
    json_extract_string(p_tasks, '$[0].sql_task.dashboard.dashboard_id') AS dashboard_id,
    json_extract_string(p_tasks, '$[0].sql_task.query.query_id') AS query_id,
    coalesce(update_info.tasks[1].sql_task.warehouse_id, json_extract_string(p_tasks, '$[0].sql_task.warehouse_id'))
      AS warehouse_id,
    error, update_info, param_name, param_job_id, param_job_id_2, n_params, response_result
  FROM job_events
)"""

SQL["schedule_changes"] = _with(AUDIT, CHANGES) + """
SELECT workspace_id, event_time, service_name, action_name, user_email, schedule_cron,
       schedule_info.timezone_id AS schedule_timezone, pause_status, status, from_redash_ind, job_id, job_name,
       alert_id, dashboard_id, query_id, warehouse_id, error,
       update_info.schedule.quartz_cron_expression AS update_cron,
       param_name, param_job_id, param_job_id_2, n_params, response_result
FROM changes"""

SQL["schedule_changes_order"] = _with(AUDIT, CHANGES) + """
SELECT job_id, event_time, action_name, workspace_id, job_name, schedule_cron,
       row_number() OVER (ORDER BY job_id NULLS FIRST, event_time NULLS FIRST, action_name NULLS FIRST, workspace_id NULLS FIRST,
                          job_name NULLS FIRST, schedule_cron NULLS FIRST) AS position
FROM changes"""

# newest time of each job overall and among rows carrying a cron, a pause status, or a
# create-time schedule; every row at such a time takes that role (ties multiply)
LATEST = """
role_times AS (
  SELECT job_id,
         max(event_time) AS t_last,
         max(event_time) FILTER (WHERE schedule_cron IS NOT NULL) AS t_cron,
         max(event_time) FILTER (WHERE pause_status IS NOT NULL) AS t_pause,
         max(event_time) FILTER (WHERE schedule_info IS NOT NULL) AS t_create
  FROM changes WHERE job_id IS NOT NULL GROUP BY job_id
),
last_rows AS (
  SELECT c.* FROM changes c JOIN role_times r USING (job_id) WHERE c.event_time IS NOT DISTINCT FROM r.t_last
),
cron_rows AS (
  SELECT c.job_id, c.schedule_cron, c.pause_status, c.schedule_info, c.job_name, c.dashboard_id, c.alert_id,
         c.query_id, c.warehouse_id
  FROM changes c JOIN role_times r USING (job_id)
  WHERE c.schedule_cron IS NOT NULL AND c.event_time IS NOT DISTINCT FROM r.t_cron
),
pause_rows AS (
  SELECT c.job_id, c.pause_status
  FROM changes c JOIN role_times r USING (job_id)
  WHERE c.pause_status IS NOT NULL AND c.event_time IS NOT DISTINCT FROM r.t_pause
),
create_rows AS (
  SELECT c.job_id, c.job_name, c.dashboard_id, c.alert_id, c.query_id, c.warehouse_id
  FROM changes c JOIN role_times r USING (job_id)
  WHERE c.schedule_info IS NOT NULL AND c.event_time IS NOT DISTINCT FROM r.t_create
),
latest AS (
  SELECT
    n.workspace_id, n.event_time AS last_updated_time, n.service_name, n.user_email,
    n.action_name AS last_updated_action,
    coalesce(n.schedule_cron, k.schedule_cron) AS schedule_cron,
    coalesce(n.pause_status, k.pause_status, p.pause_status) AS pause_status,
    coalesce(n.schedule_info, k.schedule_info, n.update_info.schedule) AS schedule_info,
    n.status, n.from_redash_ind, n.job_id,
    coalesce(n.job_name, k.job_name, cr.job_name) AS job_name,
    coalesce(n.dashboard_id, k.dashboard_id, cr.dashboard_id) AS dashboard_id,
    coalesce(n.alert_id, k.alert_id, cr.alert_id) AS alert_id,
    coalesce(n.query_id, k.query_id, cr.query_id) AS query_id,
    coalesce(n.warehouse_id, k.warehouse_id, cr.warehouse_id) AS warehouse_id,
    n.error, n.param_name, n.response_result
  FROM last_rows n
  JOIN cron_rows k ON k.job_id = n.job_id
  JOIN pause_rows p ON p.job_id = n.job_id
  JOIN create_rows cr ON cr.job_id = n.job_id
  WHERE n.action_name <> 'delete' AND n.from_redash_ind = 'true'
)"""

SQL["latest_schedules"] = _with(AUDIT, CHANGES, LATEST) + """
SELECT workspace_id, last_updated_time, service_name, user_email, last_updated_action, schedule_cron, pause_status,
       schedule_info.quartz_cron_expression AS schedule_info_cron, schedule_info.timezone_id AS schedule_timezone,
       status, from_redash_ind, job_id, job_name, dashboard_id, alert_id, query_id, warehouse_id, error,
       param_name, response_result
FROM latest"""

SQL["latest_per_key"] = _with(TIMELINE) + """
SELECT t.job_id, t.run_id, t.task_key, t.result_state, t.period_start_time
FROM timeline t
JOIN (SELECT job_id, max(period_start_time) AS newest FROM timeline GROUP BY job_id) m
  ON m.job_id IS NOT DISTINCT FROM t.job_id
WHERE t.period_start_time IS NOT DISTINCT FROM m.newest"""

# --- audit log: runs ---------------------------------------------------------------------

RUNS = f"""
run_ev AS (
  SELECT workspace_id, event_time, service_name, action_name,
    coalesce(json_extract_string(result, '$.job_id'), p_job_id, p_jobId) AS job_id,
    coalesce(p_multitaskParentRunId, p_runId) AS main_run_id,
    p_jobTaskType AS task_type, p_taskKey AS task_key, p_jobTriggerType AS trigger_type, p_queryIds AS query_id,
    p_dashboardId AS dashboard_id, p_alertId AS alert_id, p_warehouseId AS warehouse_id,
    p_runCreatorUserName AS creator_name, status_code AS status, error_message AS error,
    ((p_jobId IS NOT NULL)::BIGINT + (p_runId IS NOT NULL)::BIGINT + (p_jobTriggerType IS NOT NULL)::BIGINT + (p_multitaskParentRunId IS NOT NULL)::BIGINT + (p_taskKey IS NOT NULL)::BIGINT + (p_jobTaskType IS NOT NULL)::BIGINT + (p_queryIds IS NOT NULL)::BIGINT + (p_alertId IS NOT NULL)::BIGINT + (p_dashboardId IS NOT NULL)::BIGINT + (p_warehouseId IS NOT NULL)::BIGINT + (p_runCreatorUserName IS NOT NULL)::BIGINT) AS n_params,
    p_runId AS param_run_id, error_message AS response_error
  FROM audit
  WHERE service_name = 'jobs' AND action_name IN ('runTriggered', 'runStart', 'runSucceeded', 'runFailed')
),
triggers AS (
  SELECT workspace_id, service_name, action_name, job_id, main_run_id, trigger_type, event_time AS triggered_event_time
  FROM run_ev WHERE action_name = 'runTriggered'
),
task_starts AS (
  SELECT job_id, main_run_id, event_time AS run_event_time, task_type, task_key, query_id, dashboard_id, alert_id,
         warehouse_id
  FROM run_ev WHERE action_name = 'runStart' AND task_key IN {SQL_TASK_KEYS}
),
task_ends AS (
  SELECT job_id, main_run_id, event_time AS run_end_event_time, action_name AS end_action, status, error
  FROM run_ev WHERE action_name IN ('runSucceeded', 'runFailed') AND task_key IN {SQL_TASK_KEYS}
),
runs AS (
  SELECT tr.workspace_id, tr.service_name, coalesce(te.end_action, tr.action_name) AS run_state,
         tr.job_id, tr.main_run_id, tr.trigger_type, tr.triggered_event_time, ts.run_event_time,
         te.run_end_event_time, date_diff('second', ts.run_event_time, te.run_end_event_time) AS run_duration_seconds,
         ts.task_type, ts.task_key, ts.query_id, ts.dashboard_id, ts.alert_id, ts.warehouse_id, te.status, te.error
  FROM triggers tr
  LEFT JOIN task_starts ts ON ts.job_id = tr.job_id AND ts.main_run_id = tr.main_run_id
  LEFT JOIN task_ends te ON te.job_id = tr.job_id AND te.main_run_id = tr.main_run_id
)"""

SQL["run_events"] = _with(AUDIT, RUNS) + "SELECT * FROM run_ev"

SQL["run_history"] = _with(_once(AUDIT), RUNS) + "SELECT * FROM runs"

SQL["run_stats"] = _with(AUDIT, RUNS) + """
SELECT workspace_id, job_id, task_key, run_state, query_id, dashboard_id, alert_id,
       count(DISTINCT main_run_id) AS total_num_runs,
       CAST(sum(date_diff('second', run_event_time, run_end_event_time)) AS BIGINT) AS total_run_duration_seconds,
       coalesce(string_agg(DISTINCT warehouse_id, ',' ORDER BY warehouse_id), '') AS warehouses
FROM runs
GROUP BY workspace_id, job_id, task_key, run_state, query_id, dashboard_id, alert_id"""
SQL["run_stats_sql"] = _with(AUDIT, RUNS) + """
SELECT trigger_type, run_state, count(*) AS run_rows, count(DISTINCT job_id) AS jobs, max(triggered_event_time) AS last_trigger
FROM runs
GROUP BY trigger_type, run_state"""

SQL["schedule_with_runs"] = _with(AUDIT, CHANGES, LATEST, RUNS) + """,
per_job AS (
  SELECT workspace_id, job_id, max(triggered_event_time) AS last_run_time, count(main_run_id) AS total_num_runs,
         CAST(sum(run_duration_seconds) AS BIGINT) AS total_run_duration_seconds
  FROM runs GROUP BY workspace_id, job_id
)
SELECT l.job_id, l.workspace_id, l.last_updated_time, l.last_updated_action, l.schedule_cron, l.pause_status,
       l.warehouse_id, j.last_run_time, j.total_num_runs, j.total_run_duration_seconds
FROM latest l LEFT JOIN per_job j ON j.job_id = l.job_id AND j.workspace_id = l.workspace_id"""

SQL["timeline_run_stats"] = _with(TIMELINE) + f"""
SELECT workspace_id, job_id, task_key, result_state,
       count(DISTINCT run_id) AS total_num_runs,
       CAST(sum(date_diff('second', period_start_time, period_end_time)) AS BIGINT) AS total_run_duration_seconds,
       warehouses
FROM (
  -- first occurrences in their order; a missing element counts as one more value
  SELECT *, array_to_string(list_filter(ids, lambda x, i: list_position(ids, x) = i), ',') AS warehouses
  FROM (SELECT *, list_transform(compute_ids, lambda x: coalesce(x, 'null')) AS ids FROM timeline)
)
WHERE task_key IN {SQL_TASK_KEYS}
GROUP BY workspace_id, job_id, task_key, result_state, warehouses"""

# --- audit log: dashboards ------------------------------------------------------------------

PUBLISHERS = """
publishers AS (
  SELECT dashboard_id, email AS publisher FROM (
    SELECT p_dashboard_id AS dashboard_id, email,
           row_number() OVER (PARTITION BY p_dashboard_id ORDER BY event_time DESC, email DESC) AS pick
    FROM audit
    WHERE event_date >= DATE '2023-01-01' AND action_name = 'publishDashboard'
  ) WHERE pick = 1
)"""

SQL["dashboard_publishers"] = _with(AUDIT, PUBLISHERS) + "SELECT dashboard_id, publisher FROM publishers"

_DASH_SECONDS = [
    ("total_duration", "total_duration_ms"), ("waiting_for_compute_duration", "waiting_for_compute_duration_ms"),
    ("waiting_at_capacity_duration", "waiting_at_capacity_duration_ms"), ("execution_duration", "execution_duration_ms"),
    ("compilation_duration", "compilation_duration_ms"), ("total_task_duration", "total_task_duration_ms"),
    ("result_fetch_duration", "result_fetch_duration_ms"),
]
_DASH_SECONDS_SQL = ",\n  ".join(f"{_rd(f'CAST(h.{src} AS DOUBLE) / 1000')} AS {name}" for name, src in _DASH_SECONDS)

SQL["dashboard_queries"] = _with(AUDIT, QUERY_HISTORY, PUBLISHERS) + f"""
SELECT
  a.workspace_id, a.p_dashboard_id AS dashboard_id, a.request_id, h.statement_id,
  CASE WHEN lower(a.user_agent) LIKE '%lakeview_processing%' THEN 'scheduled' ELSE 'interactive' END AS mode,
  coalesce(d.publisher, h.executed_by) AS user_owner,
  {_DASH_SECONDS_SQL},
  CAST(h.start_time AS DATE) AS start_date, CAST(h.end_time AS DATE) AS end_date, CAST(h.update_time AS DATE) AS update_date,
  a.action_name, a.event_date,
  h.statement_text, h.execution_status, h.statement_type, h.client_application, h.error_message, h.read_bytes,
  h.read_io_cache_percent, h.from_result_cache, h.spilled_local_bytes, h.warehouse_id
FROM audit a
JOIN qh h ON h.statement_id = a.p_statement_id
LEFT JOIN publishers d ON d.dashboard_id = a.p_dashboard_id
WHERE a.action_name = 'executeQuery'"""

_AUDIT_COLS = (
    "a.workspace_id, a.event_time, a.event_date, a.service_name, a.action_name, a.email AS user_email, a.user_agent, "
    "a.request_id, a.p_statement_id AS param_statement_id, a.status_code"
)

SQL["audit_by_dashboard"] = _with(AUDIT) + f"""
SELECT {_AUDIT_COLS} FROM audit a
WHERE a.service_name = 'dashboards' AND a.p_dashboard_id = '{ONE_DASHBOARD}'"""

SQL["audit_with_publisher"] = _with(_once(AUDIT), PUBLISHERS) + f"""
SELECT {_AUDIT_COLS}, d.dashboard_id, d.publisher
FROM audit a JOIN publishers d ON d.dashboard_id = a.p_dashboard_id"""

SQL["usage_by_sku"] = _with(USAGE) + (
    "SELECT " + _cols("", ["usage_start_time", "usage_end_time", "usage_date", "sku_name", "usage_quantity", "warehouse_id"])
    + " FROM usage WHERE lower(sku_name) LIKE '%serverless%sql%'"
)

SQL["warehouse_events"] = _with(WAREHOUSE_EVENTS) + "SELECT * FROM warehouse_events_v"
