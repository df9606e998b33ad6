"""Per-statement timing metrics (D1), text flags and weights (D2), fleet averages (D3)."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GIB = 1024 * 1024 * 1024

# Output names of the metric stage, in report order.
METRIC_COLUMNS = [
    "workspace_id", "statement_id", "executed_by", "statement_text", "warehouse_id",
    "execution_status", "statement_type", "client_application", "error_message",
    "QueryRuntimeSeconds", "CPUTotalExecutionTime", "ExecutionQueryTime", "CompilationQueryTime",
    "QueueQueryTime", "StartUpQueryTime", "ResultFetchTime", "TotalResourceTimeUsedForAllocation",
    "start_time", "end_time", "update_time", "read_bytes", "read_io_cache_percent",
    "from_result_cache", "spilled_local_bytes", "TotalCPUTime_To_Execution_Time_Ratio",
    "ProportionQueueTime",
]
AVERAGE_COLUMNS = ["WarehouseAvgQueryRuntime", "WarehouseAvgQueueTime", "WarehouseAvgProportionTimeQueueing"]
FLAG_COLUMNS = [
    "ReadDataAmountInGB", "UsedCacheFlag", "HasSpillFlag", "ReadDataFlag", "UsedWorkerTasksFlag",
    "Calc_HasSpillFlag", "Calc_ReadDataFlag", "Calc_UsedWorkerTasksFlag",
]

# Flag texts and weights of the reports.
USED_CACHE, NO_CACHE = "Used Cache", "No Cache"
SPILLED, NO_SPILL = "Spilled Data To Disk", "No Spill"
DID_READ, NO_READ = "Did Read Data", "No Data Read"
USED_WORKERS, NO_WORKERS = "UsedWorkerTasks", "NoWorkers"
READ_WEIGHT = Decimal("0.25")
WORKER_WEIGHT = Decimal("0.25")


def _seconds(ms: str) -> str:
    return f"try_divide({ms}, 1000)"


def _seconds_or_zero(ms: str) -> str:
    return f"coalesce({_seconds(ms)}, 0D)"


# Expressions as SQL text, for the operators below and for views that a catalog keeps as text.
METRICS_SQL = {
    **{c: c for c in ("workspace_id", "statement_id", "executed_by", "statement_text")},
    "warehouse_id": "compute.warehouse_id",
    **{c: c for c in ("execution_status", "statement_type", "client_application")},
    "error_message": "coalesce(error_message, 'None')",
    "QueryRuntimeSeconds": _seconds_or_zero("total_duration_ms"),
    "CPUTotalExecutionTime": _seconds_or_zero("total_task_duration_ms"),
    "ExecutionQueryTime": _seconds_or_zero("execution_duration_ms"),
    "CompilationQueryTime": _seconds_or_zero("compilation_duration_ms"),
    "QueueQueryTime": _seconds_or_zero("waiting_at_capacity_duration_ms"),
    "StartUpQueryTime": _seconds_or_zero("waiting_for_compute_duration_ms"),
    "ResultFetchTime": _seconds_or_zero("result_fetch_duration_ms"),
    # metadata-only statements (no task time) get no allocation time
    "TotalResourceTimeUsedForAllocation": f"CASE WHEN {_seconds_or_zero('total_task_duration_ms')} = 0 THEN 0D "
    f"ELSE {_seconds_or_zero('total_duration_ms')} + {_seconds_or_zero('compilation_duration_ms')} END",
    **{c: c for c in ("start_time", "end_time", "update_time")},
    "read_bytes": "coalesce(read_bytes, 0L)",
    "read_io_cache_percent": "coalesce(read_io_cache_percent, 0)",
    "from_result_cache": "from_result_cache",
    "spilled_local_bytes": "coalesce(spilled_local_bytes, 0L)",
    "TotalCPUTime_To_Execution_Time_Ratio": "try_divide(total_task_duration_ms, total_duration_ms)",
    "ProportionQueueTime": "coalesce(try_divide(waiting_at_capacity_duration_ms, total_duration_ms), 0D)",
    "ReadDataAmountInGB": f"CASE WHEN read_bytes > 0 THEN try_divide(read_bytes, {GIB}) ELSE 0D END",
}
FLAGS_SQL = {
    "UsedCacheFlag": f"CASE WHEN read_io_cache_percent > 0 THEN '{USED_CACHE}' ELSE '{NO_CACHE}' END",
    "HasSpillFlag": f"CASE WHEN spilled_local_bytes > 0 THEN '{SPILLED}' ELSE '{NO_SPILL}' END",
    "ReadDataFlag": f"CASE WHEN read_bytes > 0 THEN '{DID_READ}' ELSE '{NO_READ}' END",
    "UsedWorkerTasksFlag": f"CASE WHEN CPUTotalExecutionTime > 0 THEN '{USED_WORKERS}' ELSE '{NO_WORKERS}' END",
    "Calc_HasSpillFlag": "CASE WHEN spilled_local_bytes > 0 THEN 1 ELSE 0 END",
    "Calc_ReadDataFlag": f"CASE WHEN read_bytes > 0 THEN {READ_WEIGHT} ELSE 0 END",
    "Calc_UsedWorkerTasksFlag": f"CASE WHEN CPUTotalExecutionTime > 0 THEN {WORKER_WEIGHT} ELSE 0 END",
}
#: What each fleet average is taken of; NULL values don't count.
AVERAGED_SQL = {
    "WarehouseAvgQueryRuntime": _seconds("total_duration_ms"),
    "WarehouseAvgQueueTime": _seconds("waiting_at_capacity_duration_ms"),
    "WarehouseAvgProportionTimeQueueing": f"coalesce(try_divide({_seconds('waiting_at_capacity_duration_ms')}, {_seconds('total_duration_ms')}), 0D)",
}


def statement_metrics(history: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Durations in seconds (0 when missing), allocation time, ratios, GB read.

    Divisions never raise: a zero or NULL denominator gives NULL, then the default.
    ``extra`` raw history columns are carried along after the metric columns.
    """
    return history.select(*[F.expr(e).alias(n) for n, e in METRICS_SQL.items()], *extra)


def with_statement_flags(metrics: DataFrame) -> DataFrame:
    """Four text flags and three weights over the D1 output."""
    return metrics.withColumns({n: F.expr(e) for n, e in FLAGS_SQL.items()})


_GROUPABLE = {"warehouse_id": "compute.warehouse_id", "workspace_id": "workspace_id"}
DAY = "day"


def daily_average_sums(history: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum and count of each averaged value per day of start (and ``by``): partial sums that add up over any days.

    Rows without a start time have a NULL day. Stored as a table and extended by each new day's rows, they
    stand in for the history in :func:`with_fleet_averages`; a day that gets late rows is summed anew.
    """
    keys = [F.col("start_time").cast("date").alias(DAY), *[F.col(_GROUPABLE[k]).alias(k) for k in by]]
    sums = [f(F.expr(e)).alias(f"{n}_{kind}") for n, e in AVERAGED_SQL.items() for kind, f in (("sum", F.sum), ("count", F.count))]
    return history.groupBy(*keys).agg(*sums)


def with_fleet_averages(
    df: DataFrame, history: DataFrame, by: Sequence[str] = (), daily: DataFrame | None = None, daily_until: Column | None = None
) -> DataFrame:
    """D3: averages over *all* of ``history`` attached to each row of ``df``.

    Without ``by`` each average is a scalar subquery: Spark merges the three into one
    aggregate over two columns (partial sums on every task, one tiny final merge) and
    inlines the result, so no row of ``df`` moves. ``by`` (``warehouse_id`` /
    ``workspace_id``) averages per key instead and joins on it.

    With ``daily`` (a table of :func:`daily_average_sums` with the same ``by``) and ``daily_until`` (a date), the days
    before that date are read from it, and of ``history`` only the rows since: the averages are the
    same, while the report's cost no longer grows with the age of the history.
    """
    if (daily is None) != (daily_until is None):
        raise ValueError("daily and daily_until go together")
    if daily is None:
        exprs = {name: F.avg(F.expr(e)) for name, e in AVERAGED_SQL.items()}
        read = history
        keys = [F.col(_GROUPABLE[k]).alias(k) for k in by]
    else:
        days = daily.where((F.col(DAY) < daily_until) | F.col(DAY).isNull())
        read = days.unionByName(daily_average_sums(history.where(F.col("start_time") >= daily_until), by))
        exprs = {name: F.try_divide(F.sum(f"{name}_sum"), F.sum(f"{name}_count")) for name in AVERAGED_SQL}
        keys = [F.col(k) for k in by]
    if not by:
        return df.withColumns({name: read.select(e).scalar() for name, e in exprs.items()})
    per_key = read.groupBy(*keys).agg(*[e.alias(n) for n, e in exprs.items()])
    return df.join(per_key, list(by), "left")
