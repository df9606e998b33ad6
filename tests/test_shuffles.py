"""What the shuffles of the audit reports carry."""

import re

from pyspark.sql import functions as F

from builders import audit
from conftest import ts
from plan_inspect import formatted_plan
from usagelens.operators import audit_with_publisher, dashboard_publishers, run_events, run_history
from usagelens.sources import fixtures


def _written(df):
    """Rows that each exchange of the executed plan wrote, at most."""
    df.collect()
    sent, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Exchange":
            sent.append(node.metrics().apply("shuffleRecordsWritten").value())
    return sent


def test_rows_without_dashboard_are_not_sent_to_the_publishers(spark):
    day = {"service_name": "dashboards", "workspace_id": 1, "event_time": ts(2024, 1, 1), "event_date": ts(2024, 1, 1).date()}
    recs = [{**day, "action_name": "publishDashboard", "email": "p", "request_params": {"dashboard_id": "d1"}}]
    recs += [{**day, "action_name": "getDashboard", "request_id": f"r{i}", "request_params": {"dashboard_id": f"d{i % 2}"}} for i in range(20)]
    recs += [{**day, "action_name": "getDashboard", "request_params": {}} for _ in range(500)]
    log = audit(spark, *recs)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = audit_with_publisher(log, dashboard_publishers(log))
        assert max(_written(out)) == 21
        assert {(r.dashboard_id, r.publisher) for r in out.collect()} == {("d1", "p")} and out.count() == 11
    finally:
        for k in conf:
            spark.conf.unset(k)


def _mapped_log(spark):
    orders = spark.createDataFrame([(1, 7, ts(2024, 1, 1)), (2, None, None)], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz")
    lines = [(1, 1, 1, n, 2.0, "R") for n in range(1, 5)] + [(1, None, None, 1, None, None), (2, 1, 1, 1, 2.0, "A"), (2, 5, 5, None, 2.0, "R")]
    lineitem = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string")
    events = spark.createDataFrame([(1, ts(2024, 1, 1), 1, "view")], "event_id long, ts timestamp_ntz, user_id long, event_type string")
    return fixtures.audit_log(orders, lineitem, events)


def test_parameters_of_the_mapping_are_built_once_a_row(spark):
    plan = run_history(run_events(_mapped_log(spark)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("jobTaskType") - plan.count("[jobTaskType]") == 1
    starts = {r.request_id: r.request_params for r in _mapped_log(spark).where("action_name = 'runStart'").collect()}
    assert starts["req-s-1-2-1-1"] == {
        "jobId": "7", "multitaskParentRunId": "1", "runId": "1-2-1-1", "taskKey": "refresh-alert", "jobTaskType": "sql_task",
        "alertId": "a1", "warehouseId": "wh-1", "runCreatorUserName": "owner7@example.com",
    }
    # what is NULL has no key
    assert starts["req-s-2-1-1-1"] == {
        "multitaskParentRunId": "2", "runId": "2-1-1-1", "taskKey": "refresh-query", "jobTaskType": "sql_task", "queryIds": "q1", "warehouseId": "wh-1",
    }
    assert starts["req-s-2-5-5"] == {"multitaskParentRunId": "2", "runId": "2-5-5", "jobTaskType": "sql_task", "warehouseId": "wh-5"}


def test_payloads_that_nobody_reads_are_not_shuffled(spark):
    rows = run_history(run_events(_mapped_log(spark)))
    for df, sent in ((rows, True), (rows.drop("request_params", "response"), False), (rows.groupBy("run_state").count(), False)):
        tree = df._jdf.queryExecution().optimizedPlan().toString()
        grouped = re.search(r"Aggregate \[job_id.*", tree).group()
        assert ("request_params" in grouped) == ("response" in grouped) == sent
    # the lists are in step: each start has its own parameters, each end its own response
    for r in rows.where("run_event_time is not null").collect():
        assert r.request_params["taskKey"] == r.task_key and r.request_params.get("queryIds") == r.query_id
        assert r.response is None or r.response.status_code == r.status and r.response.error_message == r.error


def test_run_stats_build_objects_for_the_warehouses_only(spark):
    from usagelens.operators import run_stats

    tree = formatted_plan(run_stats(run_events(_mapped_log(spark)))).split("\n\n\n")[0]
    assert tree.count("ObjectHashAggregate") == 2
