"""The six telemetry inputs the reports read, and ways to load them.

On a cluster the inputs are catalog tables (``spark.table``) or Parquet folders; every
loader returns lazy DataFrames so filters and column pruning reach the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..schemas import SOURCE_SCHEMAS

SOURCE_NAMES = (
    "query_history",
    "usage",
    "list_prices",
    "audit_log",
    "task_run_timeline",
    "warehouse_events",
)

def _fits(have: T.DataType, want: T.DataType) -> bool:
    """Whether values of one type can be read as the other: same family, structs by their wanted fields."""
    if isinstance(want, T.StructType):
        names = {f.name: f.dataType for f in have.fields} if isinstance(have, T.StructType) else {}
        return all(f.name in names and _fits(names[f.name], f.dataType) for f in want.fields)
    if isinstance(want, T.ArrayType):
        return isinstance(have, T.ArrayType) and _fits(have.elementType, want.elementType)
    if isinstance(want, T.MapType):
        return isinstance(have, T.MapType) and _fits(have.keyType, want.keyType) and _fits(have.valueType, want.valueType)
    times = (T.TimestampType, T.TimestampNTZType)
    if isinstance(want, times):
        return isinstance(have, times)
    if isinstance(want, T.NumericType):
        return isinstance(have, T.NumericType)
    return isinstance(have, type(want))


def checked(name: str, df: DataFrame) -> DataFrame:
    """``df`` if it has the columns that source ``name`` needs, in fitting types; more columns are fine."""
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [
        f"{f.name} ({have[f.name].simpleString() if f.name in have else 'missing'}, needed {f.dataType.simpleString()})"
        for f in SOURCE_SCHEMAS[name].fields
        if f.name not in have or not _fits(have[f.name], f.dataType)
    ]
    if wrong:
        raise ValueError(f"source {name} lacks: {'; '.join(wrong)}")
    return df


Frame = DataFrame | Callable[[], DataFrame]


class Sources:
    """The six inputs by logical name. Each may be given as a DataFrame or as a
    zero-argument function building one; a function is called on first use only, so a
    report touching one source never plans the others."""

    __slots__ = ("_frames",)

    def __init__(self, **frames: Frame) -> None:
        unknown = set(frames) - set(SOURCE_NAMES)
        missing = set(SOURCE_NAMES) - set(frames)
        if unknown or missing:
            raise ValueError(f"unknown sources {sorted(unknown)}, missing sources {sorted(missing)}")
        object.__setattr__(self, "_frames", dict(frames))

    def __getattr__(self, name: str) -> DataFrame:
        frames = object.__getattribute__(self, "_frames")
        if name not in frames:
            raise AttributeError(name)
        value = frames[name]
        if not isinstance(value, DataFrame):
            value = frames[name] = value()
        return value

    @classmethod
    def names(cls) -> list[str]:
        return list(SOURCE_NAMES)


def from_catalog(spark: SparkSession, tables: Mapping[str, str]) -> Sources:
    """Bind each logical source to a table name, e.g. ``{"usage": "main.billing.usage", ...}``."""
    missing = [n for n in SOURCE_NAMES if n not in tables]
    if missing:
        raise ValueError(f"no table given for: {', '.join(missing)}")
    return Sources(**{n: (lambda n=n, t=tables[n]: checked(n, spark.table(t))) for n in SOURCE_NAMES})


def from_parquet(spark: SparkSession, root: str) -> Sources:
    """Read ``<root>/<logical name>`` Parquet folders (one per source)."""
    root = root.rstrip("/")
    return Sources(**{n: (lambda n=n, p=f"{root}/{n}": checked(n, spark.read.parquet(p))) for n in SOURCE_NAMES})
