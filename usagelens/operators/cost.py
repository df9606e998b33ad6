"""Cost allocation: priced usage (D6), per-pair cost (D8), per-statement cost.

Billing rows are hourly; each row's cost is spread evenly over its seconds, and every
statement running in that interval is charged its overlapping whole seconds at that
rate. Concurrent statements each pay the full rate, so totals can exceed the bill.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import elapsed_seconds
from .overlap import interval_overlap

# Fixed value: SKU pattern of the priced usage.
SERVERLESS_SQL_PATTERN = "%serverless%sql%"

STATEMENT_KEYS = ["statement_id", "workspace_id", "warehouse_id", "start_time", "end_time"]


def priced_usage(usage: DataFrame, prices: DataFrame, sku_pattern: str = SERVERLESS_SQL_PATTERN) -> DataFrame:
    """Usage rows of matching SKUs times their list price (double maths).

    The price list is joined on SKU only, so several price rows for one SKU multiply the
    cost (as in the reports). The price side is tiny; Spark broadcasts it when its
    measured size is under the broadcast threshold and shuffles otherwise.
    """
    p = prices.where(F.col("sku_name").ilike(sku_pattern)).select(
        "sku_name", F.col("pricing.default").cast("double").alias("sku_price")
    )
    u = usage.select(
        "usage_start_time",
        "usage_end_time",
        "sku_name",
        "usage_date",
        F.col("usage_quantity").cast("double").alias("usage_quantity"),
        F.col("usage_metadata.warehouse_id").alias("warehouse_id"),
    )
    return p.join(u, "sku_name").select(
        "usage_start_time",
        "usage_end_time",
        "sku_name",
        "sku_price",
        "usage_date",
        "usage_quantity",
        "warehouse_id",
        (F.col("sku_price") * F.col("usage_quantity")).alias("total_cost_for_warehouse_uptime"),
    )


def statement_windows(history: DataFrame, since: Column | None = None) -> DataFrame:
    """The narrow statement rows the cost join needs (only these columns are read)."""
    q = history.select(
        "start_time",
        "end_time",
        "statement_id",
        "workspace_id",
        F.col("compute.warehouse_id").alias("warehouse_id"),
    )
    return q if since is None else q.where(F.col("start_time") >= since)


def allocate_cost(statements: DataFrame, priced: DataFrame, bin_seconds: int | None = 3600, usage: DataFrame | None = None) -> DataFrame:
    """One row per (statement, overlapping usage interval) with seconds and rate.

    ``usage``, if given, holds the rows that ``priced`` was made from; their spans, unpriced, tell the
    overlap join how long spans get.

    Seconds are whole seconds (an overlap under 1 s costs 0). A zero-length usage
    interval has no rate (NULL), which SUM ignores.
    """
    left = statements.select(*STATEMENT_KEYS)
    right = priced.select("warehouse_id", "usage_start_time", "usage_end_time", "total_cost_for_warehouse_uptime")
    pairs = interval_overlap(
        left, right, "warehouse_id", "start_time", "end_time", "usage_start_time", "usage_end_time", bin_seconds,
        None if usage is None else usage.select("usage_start_time", "usage_end_time"),
    )
    overlap_s = elapsed_seconds(
        F.greatest(F.col("start_time"), F.col("usage_start_time")),
        F.least(F.col("end_time"), F.col("usage_end_time")),
    )
    return pairs.select(
        *STATEMENT_KEYS,
        "usage_start_time",
        "usage_end_time",
        F.coalesce(overlap_s, F.lit(0).cast("long")).alias("query_duration_in_interval"),
        F.try_divide(
            F.col("total_cost_for_warehouse_uptime"), elapsed_seconds("usage_start_time", "usage_end_time")
        ).alias("cost_per_second"),
    )


def usage_since(usage: DataFrame, since: Column | None, longest_usage_hours: float | None = None) -> DataFrame:
    """Usage rows that a statement started at or after ``since`` can overlap (their end lies after it).

    With ``longest_usage_hours``, the longest span that a usage row can have, rows are also chosen by ``usage_date``
    (the day a row starts), a day earlier than that span reaches: on a table partitioned by it whole partitions
    are left unread. Without it no such row can be ruled out and none is. A row read that is longer than stated raises
    an error, as rows left unread could be so too.
    """
    if since is None:
        return usage
    rows = usage.where(F.col("usage_end_time") > since)
    if longest_usage_hours is None:
        return rows
    days = math.ceil(longest_usage_hours / 24) + 1
    stated = elapsed_seconds("usage_start_time", "usage_end_time") <= F.lit(longest_usage_hours * 3600)
    said = F.lit(f"a usage row is longer than the stated {longest_usage_hours} hours")
    start = F.when(stated | F.col("usage_start_time").isNull(), F.col("usage_start_time")).otherwise(F.raise_error(said))
    return rows.where(F.col("usage_date") >= F.date_sub(since.cast("date"), days)).withColumn("usage_start_time", start)


def statement_cost(
    history: DataFrame,
    usage: DataFrame,
    prices: DataFrame,
    since: Column | None = None,
    sku_pattern: str = SERVERLESS_SQL_PATTERN,
    bin_seconds: int | None = 3600,
    cost_col: str = "approx_query_cost",
    longest_usage_hours: float | None = None,
) -> DataFrame:
    """Summed pair cost per statement (statement, workspace, warehouse, start, end).

    A statement with no overlapping priced usage has no row, and a running statement
    (NULL end) never overlaps. Pairs are grouped directly rather than re-joined to the
    statements, which gives the same rows while ``statement_id`` is unique in history.

    The pairs are hash-partitioned on (workspace_id, statement_id) once: that partitioning
    satisfies the grouping and is reused by the report's join to the statement rows,
    so the per-statement result is never shuffled again. With ``since`` the usage scan is
    bounded too (see :func:`usage_since`).
    """
    usage = usage_since(usage, since, longest_usage_hours)
    pairs = allocate_cost(statement_windows(history, since), priced_usage(usage, prices, sku_pattern), bin_seconds, usage)
    return (
        pairs.repartition("workspace_id", "statement_id")
        .groupBy(*STATEMENT_KEYS)
        .agg(F.sum(F.col("query_duration_in_interval") * F.col("cost_per_second")).alias(cost_col))
    )
