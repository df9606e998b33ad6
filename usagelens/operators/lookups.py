"""Whole-table look-ups: usage of a SKU pattern (D25) and a saved view or table by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cost import SERVERLESS_SQL_PATTERN


def usage_by_sku(usage: DataFrame, sku_pattern: str = SERVERLESS_SQL_PATTERN) -> DataFrame:
    """Usage rows whose SKU matches ``sku_pattern`` (case-insensitive LIKE)."""
    return usage.where(F.col("sku_name").ilike(sku_pattern))


def scan(spark: SparkSession, name: str) -> DataFrame:
    """A saved view or table by name (e.g. the warehouse-event table)."""
    return spark.table(name)
