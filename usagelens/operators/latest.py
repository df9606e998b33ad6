"""Newest row(s) per key, ties kept (``dense_rank() ... DESC = 1``).

Rank one is a group limit: Spark keeps only each task's newest rows of a key before the
shuffle (``WindowGroupLimit`` in its partial mode), so one scan suffices and a hot key
sends at most its tied newest rows from each task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANK = "_latest_rank"


def latest_per_key(
    df: DataFrame,
    key: str | Sequence[str],
    order_col: str,
    where: Column | None = None,
) -> DataFrame:
    """Rows of ``df`` (meeting ``where``) whose ``order_col`` is the newest of their key.

    Same rows as ``dense_rank() OVER (PARTITION BY key ORDER BY order_col DESC) = 1``:
    every tied row is kept; a NULL ``order_col`` ranks last, so NULL rows are kept only
    when the key has no non-NULL value; a NULL key is a group of its own.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rows = df if where is None else df.where(where)
    newest_first = Window.partitionBy(*keys).orderBy(F.col(order_col).desc_nulls_last())
    return rows.withColumn(_RANK, F.dense_rank().over(newest_first)).where(F.col(_RANK) == 1).select(*df.columns)
