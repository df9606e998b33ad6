"""Inputs: the six telemetry sources, from a catalog, Parquet folders or the test tables."""

from .fixtures import fixture_sources
from .tables import Sources, from_catalog, from_parquet

__all__ = ["Sources", "fixture_sources", "from_catalog", "from_parquet"]
