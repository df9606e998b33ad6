"""Column-expression helpers shared by the operators."""

from .text import first_block_comment, first_of, json_string_map, param
from .time import (
    as_of_date,
    elapsed_seconds,
    epoch_seconds_between,
    ms_to_seconds,
    rolling_lower_bound,
    seconds_or_zero,
    time_bin,
)

__all__ = [
    "as_of_date",
    "elapsed_seconds",
    "epoch_seconds_between",
    "first_block_comment",
    "first_of",
    "json_string_map",
    "ms_to_seconds",
    "param",
    "rolling_lower_bound",
    "seconds_or_zero",
    "time_bin",
]
