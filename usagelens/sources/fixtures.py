"""Logical telemetry sources derived from the driver's test tables (see FIXTURES.md).

Each source is a deterministic projection of ``events``, ``orders``, ``lineitem`` and
``region``; the work grows with those tables. Every timestamp stays TIMESTAMP_NTZ and
every expression here is free of the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Sources

# Fixed values of the test mapping (FIXTURES.md).
SERVERLESS_SQL_SKU = "PREMIUM_SERVERLESS_SQL_COMPUTE"
JOBS_SKU = "PREMIUM_JOBS_COMPUTE"
SCHEDULED_AGENT = "lakeview_processing/1.0 scheduler"
INTERACTIVE_AGENT = "Mozilla/5.0 browser"
RUN_TASK_KEYS = ["refresh-query", "refresh-alert", "refresh-dashboard", "other"]  # by l_linenumber % 4: 1, 2, 3, 0
TIMELINE_TASK_KEYS = ["refresh-dashboard", "refresh-alert", "sqlalert", "other"]  # by l_linenumber % 4
ASSET_KINDS = ["alert", "dashboard", "query"]  # by o_orderkey % 3
OTHER_ACTIONS = {"purchase": "getDashboard", "error": "deleteDashboard", "signup": "subscribeDashboard"}  # neither execute nor publish


# Each driver table is one Parquet file with one row group, which Spark cannot split:
# one scan task would carry the whole table through the per-row mapping below. The
# fact tables are therefore hash-partitioned on their key over the cluster's cores
# right after the scan (deterministic, so a retried task sees the same rows). No number
# of partitions is given, so adaptive execution sizes them and joins on the key reuse them.
_SPREAD_KEYS = {"events": "event_id", "orders": "o_orderkey", "lineitem": "l_orderkey"}


def _session_key(spark: SparkSession) -> str:
    try:
        return str(spark._jsparkSession.sessionUUID())
    except Exception:  # remote (Connect) session
        return str(getattr(spark, "session_id", id(spark)))


def read_driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    key = _SPREAD_KEYS.get(name)
    return df if key is None else df.repartition(key)


def _s(c: Column) -> Column:
    return c.cast("string")


def _null(dtype: str) -> Column:
    return F.lit(None).cast(dtype)


def _params(*pairs: tuple[str, Column]) -> Column:
    """``map<string,string>`` holding only the keys whose value is not NULL."""
    none = F.array().cast("array<struct<key:string,value:string>>")
    entries = [
        F.when(value.isNotNull(), F.array(F.struct(F.lit(key).alias("key"), _s(value).alias("value")))).otherwise(none)
        for key, value in pairs
    ]
    return F.map_from_entries(F.flatten(F.array(*entries)))


def _response(status: Column, error: Column, result: Column) -> Column:
    return F.struct(
        status.cast("int").alias("status_code"),
        error.cast("string").alias("error_message"),
        result.cast("string").alias("result"),
    )


def _audit(
    rows: DataFrame,
    workspace_id: Column,
    event_time: Column,
    service: str,
    action: Column,
    email: Column,
    agent: Column,
    request_id: Column,
    params: Column,
    response: Column,
) -> DataFrame:
    # A filter on a parameter would be pushed below the projection, where each mention of the map builds it
    # anew. Exploded as the one element of an array, the map is built once a row and filters stay above it.
    built = rows.withColumn("_params", F.explode_outer(F.array(params)))
    return built.select(
        workspace_id.cast("long").alias("workspace_id"),
        event_time.alias("event_time"),
        event_time.cast("date").alias("event_date"),
        F.lit(service).alias("service_name"),
        action.alias("action_name"),
        F.struct(email.alias("email")).alias("user_identity"),
        agent.alias("user_agent"),
        request_id.alias("request_id"),
        F.col("_params").alias("request_params"),
        response.alias("response"),
    )


# --- query history, usage, prices ---------------------------------------------


def query_history(events: DataFrame) -> DataFrame:
    eid, uid, v = F.col("event_id"), F.col("user_id"), F.col("value")
    d = F.round(v * 10000).cast("long")

    def ms(k: int) -> Column:
        return F.round(v * k).cast("long")

    node = F.when(eid % 9 == 0, F.lit("")).otherwise(
        F.concat(F.lit(', "node_id": "model.p.'), F.col("event_type"), F.lit('"'))
    )
    comment = F.concat(
        F.lit('/* {"app": "'),
        F.when(eid % 2 == 0, F.lit("DBT")).otherwise(F.lit("dbt")),
        F.lit('"'),
        node,
        F.lit(', "profile_name": "p'), _s(uid % 2),
        F.lit('", "target_name": "t'), _s(uid % 4),
        F.lit('", "connection_name": "c'), _s(uid % 5),
        F.when(eid % 2 == 0, F.concat(F.lit('", "dbt_version": "1.'), _s(uid % 3))).otherwise(F.lit("")),
        F.when(eid % 4 == 0, F.concat(F.lit('", "dbt_databricks_version": "1.'), _s(uid % 7))).otherwise(F.lit("")),
        F.lit('"} */ select 1'),
    )
    text = (
        F.when(eid % 3 == 0, comment)
        .when(eid % 13 == 0, F.lit("/* plain note */ select 1"))
        .when(eid % 31 == 0, F.lit("select */ 1 /*"))
        .otherwise(F.lit("select 1"))
    )
    end = F.when(eid % 29 == 0, _null("timestamp_ntz")).otherwise(
        F.timestamp_add("MILLISECOND", d, F.col("ts"))
    )
    failed = F.col("event_type") == "error"
    return events.select(
        (uid % 3).alias("workspace_id"),
        F.concat(F.lit("stmt-"), _s(eid)).alias("statement_id"),
        F.concat(F.lit("user"), _s(uid), F.lit("@example.com")).alias("executed_by"),
        text.alias("statement_text"),
        F.struct(F.concat(F.lit("wh-"), _s(uid % 8)).alias("warehouse_id")).alias("compute"),
        F.when(failed, "FAILED").otherwise("FINISHED").alias("execution_status"),
        F.when(F.col("event_type") == "purchase", "INSERT").otherwise("SELECT").alias("statement_type"),
        F.when(eid % 4 == 0, "dbt-cli").when(eid % 4 == 1, "DBT").otherwise("Editor").alias("client_application"),
        F.when(failed, F.lit("boom")).otherwise(_null("string")).alias("error_message"),
        F.when(eid % 17 == 0, _null("long")).when(eid % 19 == 0, F.lit(0).cast("long")).otherwise(d).alias("total_duration_ms"),
        F.when(eid % 5 == 0, F.lit(0).cast("long")).otherwise(d * 2).alias("total_task_duration_ms"),
        ms(8000).alias("execution_duration_ms"),
        ms(500).alias("compilation_duration_ms"),
        F.when(eid % 7 == 0, _null("long")).otherwise(ms(1000)).alias("waiting_at_capacity_duration_ms"),
        ms(300).alias("waiting_for_compute_duration_ms"),
        ms(100).alias("result_fetch_duration_ms"),
        F.col("ts").alias("start_time"),
        end.alias("end_time"),
        end.alias("update_time"),
        F.when(eid % 6 == 0, F.lit(0).cast("long")).when(eid % 23 == 0, _null("long")).otherwise(eid * 1048576).alias("read_bytes"),
        F.when(eid % 3 == 0, _null("int")).otherwise((eid % 101).cast("int")).alias("read_io_cache_percent"),
        (eid % 10 == 0).alias("from_result_cache"),
        F.when(eid % 11 == 0, eid * 1024).otherwise(F.lit(0).cast("long")).alias("spilled_local_bytes"),
    )


def _hour_floor(ts: Column) -> Column:
    """Start of the hour of a TIMESTAMP_NTZ, computed from its fields (no time zone involved)."""
    return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.lit(0), F.lit(0))


def usage(events: DataFrame) -> DataFrame:
    hourly = events.groupBy(
        (F.col("user_id") % 8).alias("wk"), _hour_floor(F.col("ts")).alias("usage_start_time")
    ).agg(F.count(F.lit(1)).alias("n"))
    return hourly.select(
        "usage_start_time",
        F.timestamp_add("HOUR", F.lit(1), F.col("usage_start_time")).alias("usage_end_time"),
        F.col("usage_start_time").cast("date").alias("usage_date"),
        F.when(F.col("wk") < 6, SERVERLESS_SQL_SKU).otherwise(JOBS_SKU).alias("sku_name"),
        (F.col("n").cast("double") * 0.5).alias("usage_quantity"),
        F.struct(F.concat(F.lit("wh-"), _s(F.col("wk"))).alias("warehouse_id")).alias("usage_metadata"),
    )


def list_prices(region: DataFrame) -> DataFrame:
    r = F.col("r_regionkey")
    return region.select(
        # two price rows of one SKU on purpose: they multiply its cost
        F.when(r.isin(0, 4), SERVERLESS_SQL_SKU).when(r == 1, JOBS_SKU).otherwise(F.concat(F.lit("OTHER_"), _s(r))).alias("sku_name"),
        F.struct(F.when(r == 0, 0.7).when(r == 1, 0.15).when(r == 4, 0.05).otherwise(1.0).alias("default")).alias("pricing"),
    )


# --- audit log -----------------------------------------------------------------


def _asset_changes(orders: DataFrame) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    m10 = k % 10
    action = F.when(m10 <= 6, "create").when(m10 <= 8, "update").otherwise("delete")
    is_create, is_settings = m10 <= 6, m10 == 7
    kind = F.element_at(F.array(*[F.lit(x) for x in ASSET_KINDS]), (k % 3 + 1).cast("int"))
    one_task = F.concat(
        F.lit('{"task_key": "'), kind, F.lit('_task", "sql_task": {"'), kind, F.lit('": {"'), kind,
        F.lit('_id": "x'), _s(c), F.lit('", "pause_subscriptions": false}, "warehouse_id": "wh-'),
        _s(c % 8), F.lit('"}}'),
    )
    second = F.lit('{"task_key": "second", "sql_task": {"query": {"query_id": "never"}, "warehouse_id": "wh-never"}}')
    tasks = F.concat(
        F.lit("["), F.when(k % 11 == 0, F.lit("")).when(k % 7 == 0, F.concat(one_task, F.lit(", "), second)).otherwise(one_task), F.lit("]")
    )
    schedule = F.concat(
        F.lit('{"quartz_cron_expression": "0 '), _s(k % 60),
        F.lit(' * * * ?", "timezone_id": "UTC", "pause_status": "'),
        F.when(k % 4 == 0, "PAUSED").otherwise("UNPAUSED"), F.lit('"}'),
    )
    new_settings = F.concat(
        F.lit('{"schedule": {"quartz_cron_expression": "0 '), _s((k + 30) % 60),
        F.lit(' 6 * * ?", "timezone_id": "UTC", "pause_status": "'),
        F.when(k % 4 == 1, "UNPAUSED").otherwise("PAUSED"),
        F.lit('"}, "tasks": [{"task_key": "dashboard_task", "sql_task": {"dashboard": {"dashboard_id": "x'),
        _s(c), F.lit('", "pause_subscriptions": true}, "warehouse_id": "wh-'), _s((c + 1) % 8), F.lit('"}}]}'),
    )
    params = _params(
        ("name", F.when(is_create, F.concat(F.lit("job-"), _s(c)))),
        ("is_from_redash", F.when(is_create, F.when(k % 5 == 0, "false").otherwise("true"))),
        ("tasks", F.when(is_create, tasks)),
        ("schedule", F.when(is_create, schedule)),
        ("job_id", F.when(is_settings, c)),
        ("new_settings", F.when(is_settings, new_settings)),
        ("jobId", F.when(m10 >= 8, c)),
    )
    event_time = F.timestamp_add("SECOND", k % 86400, F.col("o_orderdate"))
    return _audit(
        orders,
        c % 3, event_time, "jobs", action,
        F.concat(F.lit("owner"), _s(c % 20), F.lit("@example.com")),
        F.lit("jobs-client/2.1"), F.concat(F.lit("req-c-"), _s(k)), params,
        _response(F.lit(200), _null("string"),
                  F.when(is_create, F.concat(F.lit('{"job_id": '), _s(c), F.lit("}")))),
    )


def _run_triggers(orders: DataFrame) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    params = _params(
        ("jobId", c), ("runId", k),
        ("jobTriggerType", F.when(k % 2 == 0, "periodic").otherwise("one_time")),
    )
    return _audit(
        orders,
        c % 3, F.col("o_orderdate"), "jobs", F.lit("runTriggered"),
        F.concat(F.lit("owner"), _s(c % 20), F.lit("@example.com")),
        F.lit("jobs-scheduler/1.0"), F.concat(F.lit("req-t-"), _s(k)), params,
        _response(F.lit(200), _null("string"), _null("string")),
    )


def _run_tasks(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """One start per line and one end per line flagged R or A."""
    lines = lineitem.join(
        orders.select("o_orderkey", "o_custkey", "o_orderdate"),
        F.col("l_orderkey") == F.col("o_orderkey"),
    )
    k, c, ln = F.col("o_orderkey"), F.col("o_custkey"), F.col("l_linenumber")
    # without a line number there is no task key; Spark takes an element of literals for never NULL
    task_key = F.when(ln.isNotNull(), F.element_at(F.array(*[F.lit(x) for x in RUN_TASK_KEYS]), F.pmod(ln - 1, F.lit(4)) + 1))
    start = F.timestamp_add("SECOND", ln, F.col("o_orderdate"))
    email = F.concat(F.lit("owner"), _s(c % 20), F.lit("@example.com"))
    # line numbers repeat within an order, so they do not name a task run alone
    run_id = F.concat_ws("-", _s(k), _s(ln), _s(F.col("l_partkey")), _s(F.col("l_suppkey")))
    starts = _audit(
        lines,
        c % 3, start, "jobs", F.lit("runStart"), email, F.lit("jobs-runner/1.0"),
        F.concat(F.lit("req-s-"), run_id),
        _params(
            ("jobId", c), ("multitaskParentRunId", k), ("runId", run_id), ("taskKey", task_key),
            ("jobTaskType", F.lit("sql_task")),
            ("queryIds", F.when(ln % 4 == 1, F.concat(F.lit("q"), _s(F.col("l_partkey") % 50)))),
            ("alertId", F.when(ln % 4 == 2, F.concat(F.lit("a"), _s(F.col("l_partkey") % 50)))),
            ("dashboardId", F.when(ln % 4 == 3, F.concat(F.lit("d"), _s(F.col("l_partkey") % 50)))),
            ("warehouseId", F.concat(F.lit("wh-"), _s(F.col("l_suppkey") % 8))),
            ("runCreatorUserName", email),
        ),
        _response(F.lit(200), _null("string"), _null("string")),
    )
    flag = F.col("l_returnflag")

    def ends(returnflag: str, action: str, error: Column) -> DataFrame:
        # one branch per end action, so the action is a literal and queries that read
        # other actions prune the branch (and its join) at planning time
        return _audit(
            lines.where(flag == returnflag),
            c % 3, F.timestamp_add("SECOND", F.col("l_quantity").cast("long"), start), "jobs",
            F.lit(action), email, F.lit("jobs-runner/1.0"),
            F.concat(F.lit("req-e-"), run_id),
            _params(("jobId", c), ("multitaskParentRunId", k), ("runId", run_id), ("taskKey", task_key)),
            _response(F.lit(200), error, _null("string")),
        )

    return starts.unionByName(ends("R", "runSucceeded", _null("string"))).unionByName(
        ends("A", "runFailed", F.lit("run failed"))
    )


def _dashboard_activity(events: DataFrame) -> DataFrame:
    eid, uid, et = F.col("event_id"), F.col("user_id"), F.col("event_type")
    publish = (et == "signup") & (uid % 25 < 20)
    action = F.when(et.isin("view", "click"), "executeQuery").when(publish, "publishDashboard")
    for kind, name in OTHER_ACTIONS.items():
        action = action.when(et == kind, name)
    # some publish events lie before the reports' floor
    event_time = F.when(publish & (eid % 10 == 0), F.timestamp_add("DAY", F.lit(-600), F.col("ts"))).otherwise(F.col("ts"))
    params = _params(
        ("dashboard_id", F.concat(F.lit("d"), _s(uid % 25))),
        ("statement_id", F.when(et.isin("view", "click"), F.concat(F.lit("stmt-"), _s(eid)))),
    )
    return _audit(
        events,
        uid % 3, event_time, "dashboards", action,
        F.concat(F.lit("user"), _s(uid), F.lit("@example.com")),
        F.when(eid % 2 == 0, SCHEDULED_AGENT).otherwise(INTERACTIVE_AGENT),
        F.concat(F.lit("req-d-"), _s(eid)), params,
        _response(F.lit(200), _null("string"), _null("string")),
    )


def audit_log(orders: DataFrame, lineitem: DataFrame, events: DataFrame) -> DataFrame:
    return (
        _asset_changes(orders)
        .unionByName(_run_triggers(orders))
        .unionByName(_run_tasks(orders, lineitem))
        .unionByName(_dashboard_activity(events))
    )


# --- task-run timeline, warehouse events ----------------------------------------


def task_run_timeline(lineitem: DataFrame) -> DataFrame:
    s = F.col("l_suppkey")
    wh, other = F.concat(F.lit("wh-"), _s(s % 8)), F.concat(F.lit("wh-"), _s((s + 1) % 8))
    shape = F.col("l_orderkey") % 5
    compute = (
        F.when(shape == 0, F.array(wh, other, wh)).when(shape == 1, F.array(other, wh, other)).when(shape == 2, F.array(wh, _null("string"), wh))
        .when(shape == 3, F.array().cast("array<string>")).otherwise(F.array(wh, wh))
    )
    task_key = F.element_at(F.array(*[F.lit(x) for x in TIMELINE_TASK_KEYS]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return lineitem.select(
        (s % 3).alias("workspace_id"),
        _s(s).alias("job_id"),
        task_key.alias("task_key"),
        F.col("l_returnflag").alias("result_state"),
        _s(F.col("l_orderkey")).alias("run_id"),
        F.col("l_shipdate").alias("period_start_time"),
        F.timestamp_add("SECOND", F.col("l_quantity").cast("long"), F.col("l_shipdate")).alias("period_end_time"),
        compute.alias("compute_ids"),
    )


def warehouse_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.concat(F.lit("wh-"), _s(F.col("user_id") % 8)).alias("warehouse_id"),
        "event_type",
        F.col("ts").alias("event_time"),
    )


_DEFINED: dict[str, dict[str, Sources]] = {}


def fixture_sources(spark: SparkSession, sf_dir: str) -> Sources:
    """All six logical sources from the driver tables under ``sf_dir``.

    Each source is planned on first use, and the definitions are kept per session and
    folder (plans only, no data), like views registered once and queried many times.
    """
    session, folder = _session_key(spark), sf_dir.rstrip("/")
    for old in set(_DEFINED) - {session}:  # plans of one session only: another's may be stopped
        del _DEFINED[old]
    known = _DEFINED.setdefault(session, {})
    if folder in known:
        return known[folder]
    tables: dict[str, DataFrame] = {}

    def table(name: str) -> DataFrame:
        if name not in tables:
            tables[name] = read_driver_table(spark, sf_dir, name)
        return tables[name]

    src = Sources(
        query_history=lambda: query_history(table("events")),
        usage=lambda: usage(table("events")),
        list_prices=lambda: list_prices(table("region")),
        audit_log=lambda: audit_log(table("orders"), table("lineitem"), table("events")),
        task_run_timeline=lambda: task_run_timeline(table("lineitem")),
        warehouse_events=lambda: warehouse_events(table("events")),
    )
    known[folder] = src
    return src
