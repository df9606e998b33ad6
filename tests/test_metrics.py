from decimal import Decimal

from builders import history
from conftest import ts
from usagelens.operators import statement_metrics, with_fleet_averages, with_statement_flags
from usagelens.operators.metadata import with_client_label, with_comment_metadata, with_comment_text


def test_zero_and_null_durations_do_not_raise(spark):
    h = history(
        spark,
        {"statement_id": "a", "total_duration_ms": 0, "total_task_duration_ms": 10, "waiting_at_capacity_duration_ms": 5},
        {"statement_id": "b", "total_duration_ms": None, "total_task_duration_ms": None},
        {"statement_id": "c", "total_duration_ms": 2000, "total_task_duration_ms": 4000,
         "waiting_at_capacity_duration_ms": 500, "compilation_duration_ms": 100},
    )
    out = {r.statement_id: r for r in statement_metrics(h).collect()}
    assert out["a"].TotalCPUTime_To_Execution_Time_Ratio is None  # Q1: x / 0 -> NULL, never an error
    assert out["a"].ProportionQueueTime == 0.0
    assert out["b"].QueryRuntimeSeconds == 0.0 and out["b"].CPUTotalExecutionTime == 0.0
    assert out["b"].TotalResourceTimeUsedForAllocation == 0.0  # no task time -> no allocation
    assert out["c"].TotalResourceTimeUsedForAllocation == 2.1
    assert out["c"].TotalCPUTime_To_Execution_Time_Ratio == 2.0
    assert out["c"].ProportionQueueTime == 0.25
    assert out["b"].error_message == "None"


def test_flags_and_weights(spark):
    h = history(
        spark,
        {"statement_id": "a", "read_bytes": 2 * 1024**3, "read_io_cache_percent": 10, "spilled_local_bytes": 1,
         "total_task_duration_ms": 1},
        {"statement_id": "b", "read_bytes": None, "read_io_cache_percent": None, "spilled_local_bytes": None},
    )
    out = {r.statement_id: r for r in with_statement_flags(statement_metrics(h)).collect()}
    a, b = out["a"], out["b"]
    assert (a.UsedCacheFlag, a.HasSpillFlag, a.ReadDataFlag, a.UsedWorkerTasksFlag) == (
        "Used Cache", "Spilled Data To Disk", "Did Read Data", "UsedWorkerTasks")
    assert (b.UsedCacheFlag, b.HasSpillFlag, b.ReadDataFlag, b.UsedWorkerTasksFlag) == (
        "No Cache", "No Spill", "No Data Read", "NoWorkers")
    assert (a.Calc_HasSpillFlag, a.Calc_ReadDataFlag, a.Calc_UsedWorkerTasksFlag) == (1, Decimal("0.25"), Decimal("0.25"))
    assert (b.Calc_HasSpillFlag, b.Calc_ReadDataFlag, b.Calc_UsedWorkerTasksFlag) == (0, Decimal("0.00"), Decimal("0.00"))
    assert a.ReadDataAmountInGB == 2.0 and b.ReadDataAmountInGB == 0.0
    assert (a.read_bytes, b.read_bytes, b.spilled_local_bytes, b.read_io_cache_percent) == (2 * 1024**3, 0, 0, 0)


def test_fleet_averages_cover_all_history_not_only_shown_rows(spark):
    # Q2: averages ignore the day filter and have no warehouse partition
    h = history(
        spark,
        {"statement_id": "old", "total_duration_ms": 10000, "start_time": ts(2024, 1, 1), "compute": {"warehouse_id": "w1"}},
        {"statement_id": "new", "total_duration_ms": 2000, "start_time": ts(2024, 1, 30), "compute": {"warehouse_id": "w2"}},
        {"statement_id": "nul", "total_duration_ms": None, "start_time": ts(2024, 1, 30), "compute": {"warehouse_id": "w2"}},
    )
    shown = statement_metrics(h.where("start_time >= '2024-01-20'"))
    out = with_fleet_averages(shown, h).collect()
    assert {r.WarehouseAvgQueryRuntime for r in out} == {6.0}  # NULL ignored, old row included
    by_wh = {r.statement_id: r.WarehouseAvgQueryRuntime for r in with_fleet_averages(statement_metrics(h), h, by=["warehouse_id"]).collect()}
    assert by_wh == {"old": 10.0, "new": 2.0, "nul": 2.0}


def test_comment_metadata_missing_and_label(spark):
    h = history(
        spark,
        {"statement_id": "a", "statement_text": '/* {"app": "DBT", "node_id": "model.x", "connection_name": "c1"} */ select 1',
         "client_application": "Editor"},
        {"statement_id": "b", "statement_text": '/* {"app": "other", "connection_name": "c2"} */ select 1',
         "client_application": "DBT"},
        {"statement_id": "c", "statement_text": "select 1", "client_application": "dbt-cli"},
        {"statement_id": "d", "statement_text": "/* not json */ select 1", "client_application": "x"},
    )
    base = with_comment_text(h)
    plain = {r.statement_id: r for r in with_client_label(with_comment_metadata(base)).collect()}
    filled = {r.statement_id: r for r in with_comment_metadata(base, missing="None").collect()}
    assert plain["a"].app == "DBT" and plain["a"].DBT_Query_Type == "DBT Query"  # case-folded app
    assert plain["b"].DBT_Query_Type == "Other Query Type"  # LIKE is case-sensitive: 'DBT' client does not match
    assert plain["c"].DBT_Query_Type == "DBT Query" and plain["c"].app is None
    assert plain["a"].node_or_connection == "model.x" and plain["b"].node_or_connection == "c2"
    assert plain["c"].dbt_metadata_json == "" and plain["c"].parsed_dbt_comment is None  # Q17
    assert plain["d"].parsed_dbt_comment is None and plain["d"].DBT_Query_Type == "Other Query Type"
    assert filled["c"].node_id == "None" and filled["c"].node_or_connection == "None"  # Q16
    assert filled["a"].dbt_version == "None" and plain["a"].dbt_version is None


def test_fleet_averages_by_workspace(spark):
    h = history(
        spark,
        {"statement_id": "a", "workspace_id": 1, "total_duration_ms": 1000},
        {"statement_id": "b", "workspace_id": 1, "total_duration_ms": 3000},
        {"statement_id": "c", "workspace_id": 2, "total_duration_ms": 5000},
    )
    out = {r.statement_id: r.WarehouseAvgQueryRuntime
           for r in with_fleet_averages(statement_metrics(h), h, by=["workspace_id"]).collect()}
    assert out == {"a": 2.0, "b": 2.0, "c": 5.0}
