"""usagelens: usage, cost and activity analytics over platform telemetry, on Spark.

Every operator is a function from DataFrames to a DataFrame made of built-in Spark SQL
expressions, joins and aggregates, so Catalyst plans it and it runs distributed.
"""

from . import functions, operators, plans, sources
from .sources import Sources, fixture_sources, from_catalog, from_parquet

__all__ = ["Sources", "fixture_sources", "from_catalog", "from_parquet", "functions", "operators", "plans", "sources"]
