"""DuckDB SQL for the logical sources, built from the driver tables (FIXTURES.md).

Written independently of the Spark builders: audit payloads are JSON text again and
are parsed by DuckDB's own JSON functions in the report SQL. Request parameters are
plain nullable columns ``p_<key>`` instead of a map.
"""

# Durations in ms are rounded products of ``value``; ``d`` is the total.
_D = "CAST(round(value * 10000) AS BIGINT)"

QUERY_HISTORY = f"""
qh AS (
  SELECT
    user_id % 3 AS workspace_id,
    concat('stmt-', event_id) AS statement_id,
    concat('user', user_id, '@example.com') AS executed_by,
    CASE
      WHEN event_id % 3 = 0 THEN concat(
        '/* {{"app": "', CASE WHEN event_id % 2 = 0 THEN 'DBT' ELSE 'dbt' END, '"',
        CASE WHEN event_id % 9 = 0 THEN '' ELSE concat(', "node_id": "model.p.', event_type, '"') END,
        ', "profile_name": "p', user_id % 2, '", "target_name": "t', user_id % 4,
        '", "connection_name": "c', user_id % 5,
        CASE WHEN event_id % 2 = 0 THEN concat('", "dbt_version": "1.', user_id % 3) ELSE '' END,
        CASE WHEN event_id % 4 = 0 THEN concat('", "dbt_databricks_version": "1.', user_id % 7) ELSE '' END,
        '"}} */ select 1')
      WHEN event_id % 13 = 0 THEN '/* plain note */ select 1'
      WHEN event_id % 31 = 0 THEN 'select */ 1 /*'
      ELSE 'select 1'
    END AS statement_text,
    concat('wh-', user_id % 8) AS warehouse_id,
    CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'FINISHED' END AS execution_status,
    CASE WHEN event_type = 'purchase' THEN 'INSERT' ELSE 'SELECT' END AS statement_type,
    CASE event_id % 4 WHEN 0 THEN 'dbt-cli' WHEN 1 THEN 'DBT' ELSE 'Editor' END AS client_application,
    CASE WHEN event_type = 'error' THEN 'boom' END AS error_message,
    CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN 0 ELSE {_D} END AS total_duration_ms,
    CASE WHEN event_id % 5 = 0 THEN 0 ELSE 2 * {_D} END AS total_task_duration_ms,
    CAST(round(value * 8000) AS BIGINT) AS execution_duration_ms,
    CAST(round(value * 500) AS BIGINT) AS compilation_duration_ms,
    CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(round(value * 1000) AS BIGINT) END AS waiting_at_capacity_duration_ms,
    CAST(round(value * 300) AS BIGINT) AS waiting_for_compute_duration_ms,
    CAST(round(value * 100) AS BIGINT) AS result_fetch_duration_ms,
    ts AS start_time,
    CASE WHEN event_id % 29 = 0 THEN NULL ELSE ts + to_milliseconds({_D}) END AS end_time,
    CASE WHEN event_id % 29 = 0 THEN NULL ELSE ts + to_milliseconds({_D}) END AS update_time,
    CASE WHEN event_id % 6 = 0 THEN 0 WHEN event_id % 23 = 0 THEN NULL ELSE event_id * 1048576 END AS read_bytes,
    CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 101 AS INTEGER) END AS read_io_cache_percent,
    event_id % 10 = 0 AS from_result_cache,
    CASE WHEN event_id % 11 = 0 THEN event_id * 1024 ELSE 0 END AS spilled_local_bytes
  FROM events
)"""

USAGE = """
usage AS (
  SELECT
    usage_start_time,
    usage_start_time + INTERVAL 1 HOUR AS usage_end_time,
    CAST(usage_start_time AS DATE) AS usage_date,
    CASE WHEN wk < 6 THEN 'PREMIUM_SERVERLESS_SQL_COMPUTE' ELSE 'PREMIUM_JOBS_COMPUTE' END AS sku_name,
    CAST(n AS DOUBLE) * 0.5 AS usage_quantity,
    concat('wh-', wk) AS warehouse_id
  FROM (SELECT user_id % 8 AS wk, date_trunc('hour', ts) AS usage_start_time, count(*) AS n FROM events GROUP BY ALL)
)"""

LIST_PRICES = """
list_prices AS (
  SELECT
    CASE r_regionkey WHEN 0 THEN 'PREMIUM_SERVERLESS_SQL_COMPUTE' WHEN 4 THEN 'PREMIUM_SERVERLESS_SQL_COMPUTE' WHEN 1 THEN 'PREMIUM_JOBS_COMPUTE'
         ELSE concat('OTHER_', r_regionkey) END AS sku_name,
    CAST(CASE r_regionkey WHEN 0 THEN 0.7 WHEN 1 THEN 0.15 WHEN 4 THEN 0.05 ELSE 1.0 END AS DOUBLE) AS price
  FROM region
)"""

_OWNER = "concat('owner', o_custkey % 20, '@example.com')"
_KIND = "['alert', 'dashboard', 'query'][o_orderkey % 3 + 1]"
_TASK = "['refresh-query', 'refresh-alert', 'refresh-dashboard', 'other'][(l_linenumber - 1) % 4 + 1]"
_RUN_ID = "concat(o_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey)"
_PUBLISH = "(event_type = 'signup' AND user_id % 25 < 20)"

AUDIT = f"""
audit AS (
  SELECT *, CAST(event_time AS DATE) AS event_date FROM (
    SELECT
      o_custkey % 3 AS workspace_id,
      o_orderdate + to_seconds(o_orderkey % 86400) AS event_time,
      'jobs' AS service_name,
      CASE WHEN o_orderkey % 10 <= 6 THEN 'create' WHEN o_orderkey % 10 <= 8 THEN 'update' ELSE 'delete' END AS action_name,
      {_OWNER} AS email,
      'jobs-client/2.1' AS user_agent,
      concat('req-c-', o_orderkey) AS request_id,
      CASE WHEN o_orderkey % 10 <= 6 THEN concat('job-', o_custkey) END AS p_name,
      CASE WHEN o_orderkey % 10 <= 6 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'false' ELSE 'true' END END AS p_is_from_redash,
      CASE WHEN o_orderkey % 10 <= 6 THEN concat('[',
        CASE WHEN o_orderkey % 11 <> 0 THEN concat(
          '{{"task_key": "', {_KIND}, '_task", "sql_task": {{"', {_KIND}, '": {{"', {_KIND}, '_id": "x', o_custkey,
          '", "pause_subscriptions": false}}, "warehouse_id": "wh-', o_custkey % 8, '"}}}}') ELSE '' END,
        CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 11 <> 0
          THEN ', {{"task_key": "second", "sql_task": {{"query": {{"query_id": "never"}}, "warehouse_id": "wh-never"}}}}' ELSE '' END,
        ']') END AS p_tasks,
      CASE WHEN o_orderkey % 10 <= 6 THEN concat(
        '{{"quartz_cron_expression": "0 ', o_orderkey % 60, ' * * * ?", "timezone_id": "UTC", "pause_status": "',
        CASE WHEN o_orderkey % 4 = 0 THEN 'PAUSED' ELSE 'UNPAUSED' END, '"}}') END AS p_schedule,
      CASE WHEN o_orderkey % 10 = 7 THEN CAST(o_custkey AS VARCHAR) END AS p_job_id,
      CASE WHEN o_orderkey % 10 = 7 THEN concat(
        '{{"schedule": {{"quartz_cron_expression": "0 ', (o_orderkey + 30) % 60,
        ' 6 * * ?", "timezone_id": "UTC", "pause_status": "', CASE WHEN o_orderkey % 4 = 1 THEN 'UNPAUSED' ELSE 'PAUSED' END,
        '"}}, "tasks": [{{"task_key": "dashboard_task", "sql_task": {{"dashboard": {{"dashboard_id": "x', o_custkey,
        '", "pause_subscriptions": true}}, "warehouse_id": "wh-', (o_custkey + 1) % 8, '"}}}}]}}') END AS p_new_settings,
      CASE WHEN o_orderkey % 10 >= 8 THEN CAST(o_custkey AS VARCHAR) END AS p_jobId,
      200 AS status_code,
      CAST(NULL AS VARCHAR) AS error_message,
      CASE WHEN o_orderkey % 10 <= 6 THEN concat('{{"job_id": ', o_custkey, '}}') END AS result
    FROM orders
    UNION ALL BY NAME
    SELECT
      o_custkey % 3 AS workspace_id, o_orderdate AS event_time, 'jobs' AS service_name, 'runTriggered' AS action_name,
      {_OWNER} AS email, 'jobs-scheduler/1.0' AS user_agent, concat('req-t-', o_orderkey) AS request_id,
      CAST(o_custkey AS VARCHAR) AS p_jobId, CAST(o_orderkey AS VARCHAR) AS p_runId,
      CASE WHEN o_orderkey % 2 = 0 THEN 'periodic' ELSE 'one_time' END AS p_jobTriggerType,
      200 AS status_code
    FROM orders
    UNION ALL BY NAME
    SELECT
      o_custkey % 3 AS workspace_id, o_orderdate + to_seconds(l_linenumber) AS event_time, 'jobs' AS service_name,
      'runStart' AS action_name, {_OWNER} AS email, 'jobs-runner/1.0' AS user_agent,
      concat('req-s-', {_RUN_ID}) AS request_id,
      CAST(o_custkey AS VARCHAR) AS p_jobId, CAST(o_orderkey AS VARCHAR) AS p_multitaskParentRunId,
      {_RUN_ID} AS p_runId, {_TASK} AS p_taskKey, 'sql_task' AS p_jobTaskType,
      CASE WHEN l_linenumber % 4 = 1 THEN concat('q', l_partkey % 50) END AS p_queryIds,
      CASE WHEN l_linenumber % 4 = 2 THEN concat('a', l_partkey % 50) END AS p_alertId,
      CASE WHEN l_linenumber % 4 = 3 THEN concat('d', l_partkey % 50) END AS p_dashboardId,
      concat('wh-', l_suppkey % 8) AS p_warehouseId, {_OWNER} AS p_runCreatorUserName,
      200 AS status_code
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    UNION ALL BY NAME
    SELECT
      o_custkey % 3 AS workspace_id,
      o_orderdate + to_seconds(l_linenumber) + to_seconds(CAST(l_quantity AS BIGINT)) AS event_time,
      'jobs' AS service_name,
      CASE WHEN l_returnflag = 'R' THEN 'runSucceeded' ELSE 'runFailed' END AS action_name,
      {_OWNER} AS email, 'jobs-runner/1.0' AS user_agent, concat('req-e-', {_RUN_ID}) AS request_id,
      CAST(o_custkey AS VARCHAR) AS p_jobId, CAST(o_orderkey AS VARCHAR) AS p_multitaskParentRunId,
      {_RUN_ID} AS p_runId, {_TASK} AS p_taskKey,
      200 AS status_code,
      CASE WHEN l_returnflag = 'A' THEN 'run failed' END AS error_message
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE l_returnflag IN ('R', 'A')
    UNION ALL BY NAME
    SELECT
      user_id % 3 AS workspace_id, CASE WHEN {_PUBLISH} AND event_id % 10 = 0 THEN ts - INTERVAL 600 DAY ELSE ts END AS event_time,
      'dashboards' AS service_name,
      CASE WHEN event_type IN ('view', 'click') THEN 'executeQuery' WHEN {_PUBLISH} THEN 'publishDashboard'
           WHEN event_type = 'purchase' THEN 'getDashboard' WHEN event_type = 'error' THEN 'deleteDashboard'
           WHEN event_type = 'signup' THEN 'subscribeDashboard' END AS action_name,
      concat('user', user_id, '@example.com') AS email,
      CASE WHEN event_id % 2 = 0 THEN 'lakeview_processing/1.0 scheduler' ELSE 'Mozilla/5.0 browser' END AS user_agent,
      concat('req-d-', event_id) AS request_id,
      concat('d', user_id % 25) AS p_dashboard_id,
      CASE WHEN event_type IN ('view', 'click') THEN concat('stmt-', event_id) END AS p_statement_id,
      200 AS status_code
    FROM events
  )
)"""

TIMELINE = """
timeline AS (
  SELECT
    l_suppkey % 3 AS workspace_id,
    CAST(l_suppkey AS VARCHAR) AS job_id,
    ['refresh-dashboard', 'refresh-alert', 'sqlalert', 'other'][l_linenumber % 4 + 1] AS task_key,
    l_returnflag AS result_state,
    CAST(l_orderkey AS VARCHAR) AS run_id,
    l_shipdate AS period_start_time,
    l_shipdate + to_seconds(CAST(l_quantity AS BIGINT)) AS period_end_time,
    CASE l_orderkey % 5
      WHEN 0 THEN [concat('wh-', l_suppkey % 8), concat('wh-', (l_suppkey + 1) % 8), concat('wh-', l_suppkey % 8)]
      WHEN 1 THEN [concat('wh-', (l_suppkey + 1) % 8), concat('wh-', l_suppkey % 8), concat('wh-', (l_suppkey + 1) % 8)]
      WHEN 2 THEN [concat('wh-', l_suppkey % 8), NULL, concat('wh-', l_suppkey % 8)]
      WHEN 3 THEN CAST([] AS VARCHAR[])
      ELSE [concat('wh-', l_suppkey % 8), concat('wh-', l_suppkey % 8)] END AS compute_ids
  FROM lineitem
)"""

WAREHOUSE_EVENTS = """
warehouse_events_v AS (
  SELECT concat('wh-', user_id % 8) AS warehouse_id, event_type, ts AS event_time FROM events
)"""
