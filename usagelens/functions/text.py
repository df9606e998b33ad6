"""Text and JSON helpers over statement text and audit payloads (built-in expressions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import COMMENT_MAP

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_block_comment(text: ColumnOrName) -> Column:
    """Body of the first ``/* ... */`` comment.

    ``substr(t, instr(t,'/*') + 2, instr(t,'*/') - instr(t,'/*') - 2)``: with no comment,
    or with ``*/`` before ``/*``, the length is <= 0 and the result is ``''`` (not NULL).
    """
    t = _col(text)
    open_at = F.instr(t, "/*")
    close_at = F.instr(t, "*/")
    return t.substr(open_at + F.lit(2), close_at - open_at - F.lit(2))


def json_string_map(text: ColumnOrName) -> Column:
    """Parse a JSON object to ``map<string,string>``; malformed or empty input gives NULL,
    nested values are kept as JSON text."""
    return F.from_json(_col(text), COMMENT_MAP)


def first_of(arr: Column) -> Column:
    """Element 0 of an array, NULL when the array is NULL or empty (``[0]`` would raise under ANSI)."""
    return F.get(arr, 0)


def param(name: str, params: str = "request_params") -> Column:
    """Value of one key of a ``map<string,string>`` column, NULL when absent."""
    return F.col(params)[name]
