"""Interval-overlap join (equi key + strict overlap on both ends).

The only equality in the overlap predicate is the key (a warehouse), so a plain join
compares every statement of a warehouse with every usage interval of that warehouse.
The binned form adds a time bin to the equality: each side is exploded to the bins its
span touches, rows meet only inside a shared bin, and a pair is kept only in the bin
holding the start of the two spans' intersection, so it is emitted exactly once.

Exactness: whenever ``ls < re and le > rs`` holds, the closed spans
``[min(ls,le), max(ls,le)]`` and ``[min(rs,re), max(rs,re)]`` intersect (also for
inverted intervals), and the intersection starts at ``max(min(ls,le), min(rs,re))``
which lies in both spans, hence in a bin both sides emit. Rows with a NULL end can
never satisfy the predicate and are dropped before exploding. The result equals the
plain join row for row, for any input.

Scale: with a bin as wide as the billing grain, a usage row touches 1-2 bins and a
statement touches ``1 + duration / bin`` bins, so the join output stays linear and a hot
warehouse is spread over its hours instead of one join key. A hot hour is split by AQE:
both sides of the join have exchanges of their own.

Overlong spans (a row that seems to end centuries ahead) go to coarser levels, whose bins are ``FACTOR``
times as wide from one to the next: a span takes the lowest level at which it touches at most ``FACTOR`` + 1
bins, so no row of either side makes more. A pair meets at the higher one of its levels, where the other row emits its
bins too; which higher levels the other side uses is one number, found by a one-row aggregate over the
spans (``bit_or``), and usually none. A cell of a higher level names the side that is at
home there, so that rows which only visit it never meet each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import bin_sql

#: Width of a level's bins in bins of the level below, and number of levels: with the base bin of an
#: hour, the highest level's bins are 1,900 years wide.
FACTOR, LEVELS = 64, 5
CELL = "_ovl_cell"
_L_FIRST, _R_FIRST, _LAST, _LEVEL, _OTHERS = "_ovl_l_first", "_ovl_r_first", "_ovl_last", "_ovl_level", "_ovl_others"
_WIDTHS = [FACTOR**k for k in range(LEVELS)]
# a cell as one long: kind (level and side) above, bin below
_BINS = 1 << 44
_BOTH, _LEFT, _RIGHT = 0, 1, 2


# The rules as SQL text, for the operator and for views that a catalog keeps as text.


def _down(bin_: str, width: object) -> str:
    """The bin of a wider level (rounded down, before 1970 too)."""
    return bin_ if width == 1 else f"CAST(floor({bin_} / {width}) AS BIGINT)"


def _level(first: str, last: str) -> str:
    """The lowest level at which a span touches at most FACTOR + 1 bins."""
    steps = " ".join(f"WHEN {last} - {first} <= {FACTOR * _WIDTHS[k]} THEN {k}" for k in range(LEVELS - 1))
    return f"CASE {steps} ELSE {LEVELS - 1} END"


_LEVELS_USED = "coalesce(bit_or(shiftleft(1, {level})), 0)"


def _cells(first: str, last: str, level: str, others: str, mine: int) -> str:
    """The cells of a span: at its own level, and at the higher levels that the other side uses (bits of ``others``)."""

    def at(k: int, side: int) -> str:
        base = (3 * k + side) * _BINS + _BINS // 2
        return f"sequence({base} + {_down(first, _WIDTHS[k])}, {base} + {_down(last, _WIDTHS[k])})"

    theirs = _RIGHT if mine == _LEFT else _LEFT
    none = "CAST(array() AS ARRAY<BIGINT>)"
    parts = [f"CASE WHEN {level} = 0 THEN {at(0, _BOTH)} ELSE {none} END"]
    for k in range(1, LEVELS):
        used = f"({others} & {1 << k}) <> 0"
        parts.append(f"CASE WHEN {level} = {k} AND {used} THEN {at(k, _BOTH)} ELSE {none} END")
        parts.append(f"CASE WHEN {level} = {k} THEN {at(k, mine)} WHEN {level} < {k} AND {used} THEN {at(k, theirs)} ELSE {none} END")
    return f"CASE WHEN {level} = 0 AND {others} <= 1 THEN {at(0, _BOTH)} ELSE concat({', '.join(parts)}) END"


def owner_sql(cell: str, left_first: str, right_first: str) -> str:
    """Whether the cell's bin is that of the start of the intersection."""
    kind, bin_, begin = f"CAST(floor({cell} / {_BINS}) AS INT)", f"pmod({cell}, {_BINS}) - {_BINS // 2}", f"greatest({left_first}, {right_first})"
    width = f"element_at(array({', '.join(f'{w}L' for w in _WIDTHS)}), CAST(floor({kind} / 3) + 1 AS INT))"
    return f"CASE WHEN {kind} = 0 THEN {bin_} = {begin} ELSE {bin_} = {_down(begin, width)} END"


def spans_sql(rows: str, start: str, end: str, bin_seconds: int = 3600) -> str:
    """A query for the rows with both ends, with their first and last bin."""
    first, last = (bin_sql(f"{f}({start}, {end})", bin_seconds) for f in ("least", "greatest"))
    return f"SELECT *, {first} AS first_bin, {last} AS last_bin FROM {rows} WHERE {start} IS NOT NULL AND {end} IS NOT NULL"


def cells_sql(spans: str, other_spans: str, left: bool) -> str:
    """A query for a row per cell of the spans of one side (a result of :func:`spans_sql`)."""
    level = _level("first_bin", "last_bin")
    others = f"(SELECT {_LEVELS_USED.format(level=level)} FROM {other_spans})"
    cells = _cells("first_bin", "last_bin", "level", "others", _LEFT if left else _RIGHT)
    return f"SELECT * EXCEPT (last_bin, level, others), explode({cells}) AS cell FROM (SELECT *, {level} AS level, {others} AS others FROM {spans})"


def _spans(df: DataFrame, start: str, end: str, first_col: str, bin_seconds: int) -> DataFrame:
    rows = df.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    bins = {c: F.expr(bin_sql(f"{f}(`{start}`, `{end}`)", bin_seconds)) for c, f in ((first_col, "least"), (_LAST, "greatest"))}
    return rows.withColumns(bins).withColumn(_LEVEL, F.expr(_level(first_col, _LAST)))


def _into_cells(spans: DataFrame, first_col: str, mine: int, other_spans: DataFrame) -> DataFrame:
    used = other_spans.select(F.expr(_LEVELS_USED.format(level=_LEVEL))).scalar()  # one number of the whole other side
    cells = F.expr(_cells(first_col, _LAST, _LEVEL, _OTHERS, mine))
    return spans.withColumn(_OTHERS, used).withColumn(CELL, F.explode(cells)).drop(_LAST, _LEVEL, _OTHERS)


def interval_overlap(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    left_start: str,
    left_end: str,
    right_start: str,
    right_end: str,
    bin_seconds: int | None = 3600,
    right_spans: DataFrame | None = None,
) -> DataFrame:
    """Pairs with equal ``on`` keys and ``left_start < right_end AND left_end > right_start``.

    Column names of the two sides must differ except for the ``on`` keys, which appear
    once. ``bin_seconds=None`` runs the plain equi-join with range residuals. ``right_spans``
    (``right_start``, ``right_end``), if given, holds at least the spans of ``right`` and is read in its place to
    see which levels occur, for a right side that is dear to compute.
    """
    keys = [on] if isinstance(on, str) else list(on)
    # both sides are binned on one clock: the right side takes the left side's timestamp type
    ltype = left.schema[left_start].dataType

    def on_clock(df: DataFrame) -> DataFrame:
        for c in (right_start, right_end):
            if df.schema[c].dataType != ltype:
                df = df.withColumn(c, F.col(c).cast(ltype))
        return df

    right = on_clock(right)
    overlaps = (F.col(left_start) < F.col(right_end)) & (F.col(left_end) > F.col(right_start))
    if bin_seconds is None:
        return left.join(right, keys).where(overlaps)
    lhs = _spans(left, left_start, left_end, _L_FIRST, bin_seconds)
    rhs = _spans(right, right_start, right_end, _R_FIRST, bin_seconds)
    known = rhs if right_spans is None else _spans(on_clock(right_spans), right_start, right_end, _R_FIRST, bin_seconds)
    lhs, rhs = _into_cells(lhs, _L_FIRST, _LEFT, known), _into_cells(rhs, _R_FIRST, _RIGHT, lhs)
    owner = F.expr(owner_sql(CELL, _L_FIRST, _R_FIRST))
    out_cols = keys + [c for c in left.columns if c not in keys] + [c for c in right.columns if c not in keys]
    return lhs.join(rhs, [*keys, CELL]).where(overlaps & owner).select(*out_cols)
