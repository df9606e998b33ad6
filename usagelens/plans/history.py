"""Statement history with metrics, flags, fleet averages, comment metadata and cost.

``tool_statements`` is the shared stage of the enhanced history (D10) and the
node-cost reports (D19, D20).
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import as_of_date, rolling_lower_bound
from ..operators.cost import SERVERLESS_SQL_PATTERN, statement_cost
from ..operators.metadata import COMMENT_TEXT, METADATA_COLUMNS, with_client_label, with_comment_metadata, with_comment_text
from ..operators.metrics import AVERAGE_COLUMNS, FLAG_COLUMNS, METRIC_COLUMNS, statement_metrics, with_fleet_averages, with_statement_flags
from ..sources import Sources

AsOf = str | _dt.date | Column | None

# 38 statement columns, then the 10 metadata columns
STATEMENT_COLUMNS = [*METRIC_COLUMNS, *AVERAGE_COLUMNS, *FLAG_COLUMNS, COMMENT_TEXT]
TOOL_COLUMNS = [*STATEMENT_COLUMNS, *METADATA_COLUMNS]
ENHANCED_COLUMNS = [*TOOL_COLUMNS, "approx_query_cost"]


def tool_statements(
    history: DataFrame,
    since: Column | None,
    missing: str | None = None,
    extra: Sequence[str] = (),
    cost: DataFrame | None = None,
    cost_cols: Sequence[str] = (),
    daily: DataFrame | None = None,
    daily_until: Column | None = None,
) -> DataFrame:
    """Statements started on or after ``since`` with every per-statement column, joined
    to ``cost`` on (workspace_id, statement_id) when given.

    Fleet averages are taken over *all* of ``history`` (not only the recent rows); the
    date filter is applied to the history scan first. The cost join happens on the base
    metric columns: flags, averages, the parsed comment and the label are derived after
    it, so the shuffle carries only what the statement row holds (a filter on a derived
    column, like the tool label, is still pushed below the join by Catalyst).
    ``daily`` and ``daily_until`` are those of :func:`with_fleet_averages`.
    """
    recent = history if since is None else history.where(F.col("start_time") >= since)
    df = statement_metrics(recent, extra=extra)
    if cost is not None:
        df = df.join(cost.select("workspace_id", "statement_id", *cost_cols), ["workspace_id", "statement_id"])
    df = with_statement_flags(df)
    df = with_fleet_averages(df, history, daily=daily, daily_until=daily_until)
    df = with_comment_text(df)
    df = with_comment_metadata(df, missing=missing)
    df = with_client_label(df)
    return df.select(*TOOL_COLUMNS, *extra, *cost_cols)


def enhanced_history(
    src: Sources,
    as_of: AsOf = None,
    days: int = 15,
    sku_pattern: str = SERVERLESS_SQL_PATTERN,
    bin_seconds: int | None = 3600,
    missing: str | None = None,
    sort: bool = True,
    longest_usage_hours: float | None = None,
    daily: DataFrame | None = None,
    daily_until: str | _dt.date | Column | None = None,
) -> DataFrame:
    """D10 (flagship): statements of the last ``days`` days with their approximate cost,
    dearest first. Statements with no overlapping priced usage are left out.

    The day filter is also applied to the statements entering the cost join: cost is
    per statement and ``start_time`` is one of its keys, so with unique statement ids
    this gives the same rows while joining only the recent window. Usage partitions older than the
    window are left unread if ``longest_usage_hours`` is stated (see :func:`usage_since`), and the averages read
    ``daily`` sums for the days before ``daily_until`` if given, so that no table is read in full.
    """
    since = rolling_lower_bound(as_of, days)
    hist = src.query_history
    cost = statement_cost(
        hist, src.usage, src.list_prices, since=since, sku_pattern=sku_pattern, bin_seconds=bin_seconds, longest_usage_hours=longest_usage_hours
    )
    until = None if daily_until is None else as_of_date(daily_until)
    out = tool_statements(hist, since, missing=missing, cost=cost, cost_cols=["approx_query_cost"], daily=daily, daily_until=until)
    # ties (e.g. many zero-cost statements) are broken by the statement key, so the range
    # partitioner of the global sort can split a hot cost value over several tasks
    return out.orderBy(F.desc("approx_query_cost"), "workspace_id", "statement_id") if sort else out
