"""Time helpers. All are built-in Catalyst expressions (codegen, no Python).

They work on both TIMESTAMP and TIMESTAMP_NTZ columns and give the same answer
under any session time zone for NTZ input.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ms_to_seconds(c: ColumnOrName) -> Column:
    """Milliseconds to seconds as double; NULL stays NULL (never raises)."""
    return F.try_divide(_col(c), F.lit(1000))


def seconds_or_zero(c: ColumnOrName) -> Column:
    """``COALESCE(try_divide(ms, 1000), 0)``: the reports' duration metric."""
    return F.coalesce(ms_to_seconds(c), F.lit(0).cast("double"))


def elapsed_seconds(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Whole seconds elapsed (``TIMESTAMPDIFF(SECOND, start, end)``): truncates, so 1.9 s -> 1."""
    return F.timestamp_diff("SECOND", _col(start), _col(end))


def epoch_seconds_between(start: ColumnOrName, end: ColumnOrName) -> Column:
    """``unix_timestamp(end) - unix_timestamp(start)``.

    Counts second boundaries crossed (0.9 s -> 2.1 s gives 2), which is not the same
    as :func:`elapsed_seconds`; the run reports use this one.
    """
    return F.unix_timestamp(_col(end)) - F.unix_timestamp(_col(start))


def as_of_date(as_of: str | _dt.date | Column | None) -> Column:
    """The report date: a literal, a column, or ``current_date()`` when None."""
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, _dt.datetime):
        as_of = as_of.date()
    if isinstance(as_of, _dt.date):
        as_of = as_of.isoformat()
    return F.to_date(F.lit(as_of))


def rolling_lower_bound(as_of: str | _dt.date | Column | None, days: int) -> Column:
    """``as_of - INTERVAL days DAY`` as a DATE (midnight when compared with a timestamp)."""
    return F.date_sub(as_of_date(as_of), int(days))


def seconds_sql(start: str, end: str) -> str:
    """:func:`elapsed_seconds` as SQL text."""
    return f"timestampdiff(SECOND, {start}, {end})"


def bin_sql(time: str, bin_seconds: int) -> str:
    """:func:`time_bin` as SQL text."""
    return f"CAST(floor(unix_timestamp({time}) / {int(bin_seconds)}) AS BIGINT)"


def time_bin(c: ColumnOrName, bin_seconds: int) -> Column:
    """Integer bin index ``floor(epoch_seconds / bin_seconds)``; monotone in time."""
    return F.floor(F.unix_timestamp(_col(c)) / F.lit(int(bin_seconds))).cast("long")
