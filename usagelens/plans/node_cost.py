"""Cost of tool-issued statements by project node: rollup (D19) and drill-down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rolling_lower_bound
from ..operators.cost import SERVERLESS_SQL_PATTERN, statement_cost
from ..operators.median import with_median
from ..operators.metadata import LABEL, TOOL_LABEL
from ..sources import Sources
from .history import TOOL_COLUMNS, AsOf, tool_statements

NODE_KEYS = ["workspace_id", "profile_name", "target_name", "node_or_connection"]
MISSING = "None"


def _tool_statement_cost(
    src: Sources, as_of: AsOf, days: int, min_runtime: float, sku_pattern: str, bin_seconds: int | None
) -> DataFrame:
    since = rolling_lower_bound(as_of, days)
    hist = src.query_history
    cost = statement_cost(
        hist, src.usage, src.list_prices, since=since, sku_pattern=sku_pattern, bin_seconds=bin_seconds,
        cost_col="apprx_query_cost",
    )
    stmts = tool_statements(
        hist, since, missing=MISSING, extra=["total_task_duration_ms"], cost=cost, cost_cols=["apprx_query_cost"]
    )
    # label and runtime floor are pushed below the cost join by Catalyst
    return stmts.where((F.col(LABEL) == TOOL_LABEL) & (F.col("QueryRuntimeSeconds") > min_runtime))


def node_cost_report(
    src: Sources,
    as_of: AsOf = None,
    days: int = 10,
    min_runtime: float = 60,
    sku_pattern: str = SERVERLESS_SQL_PATTERN,
    bin_seconds: int | None = 3600,
    sort: bool = True,
) -> DataFrame:
    """Tool statements of the last ``days`` days running over ``min_runtime`` seconds,
    grouped by workspace, profile, target and node: run count, CPU and runtime sums, an
    example statement (the smallest id, so the choice is deterministic), and the sum,
    mean and exact median of the approximate cost."""
    j = _tool_statement_cost(src, as_of, days, min_runtime, sku_pattern, bin_seconds)
    cost = "apprx_query_cost"
    out = with_median(
        j,
        NODE_KEYS,
        cost,
        "med_apprx_query_cost",
        sums={
            "sum_CPUTotalExecutionTime": F.col("CPUTotalExecutionTime"),
            "sum_QueryRuntimeSeconds": F.col("QueryRuntimeSeconds"),
            "sum_apprx_query_cost": F.col(cost),
        },
        least={"example_statement_id": F.col("statement_id")},
        n_rows="num_runs",
        n_values="_priced",
    )
    out = out.withColumn("avg_apprx_query_cost", F.try_divide("sum_apprx_query_cost", "_priced")).select(
        *NODE_KEYS, "num_runs", "sum_CPUTotalExecutionTime", "sum_QueryRuntimeSeconds", "example_statement_id",
        "sum_apprx_query_cost", "avg_apprx_query_cost", "med_apprx_query_cost",
    )
    return out.orderBy(F.desc("sum_CPUTotalExecutionTime"), *NODE_KEYS) if sort else out


def node_cost_detail(
    src: Sources,
    node: str,
    as_of: AsOf = None,
    days: int = 10,
    min_runtime: float = 1,
    sku_pattern: str = SERVERLESS_SQL_PATTERN,
    bin_seconds: int | None = 3600,
) -> DataFrame:
    """Every tool statement of one node with its cost (statement columns once,
    then ``apprx_query_cost`` and the raw ``total_task_duration_ms``)."""
    j = _tool_statement_cost(src, as_of, days, min_runtime, sku_pattern, bin_seconds)
    return j.where(F.col("node_or_connection") == node).select(*TOOL_COLUMNS, "apprx_query_cost", "total_task_duration_ms")
