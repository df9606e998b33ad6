"""Independent DuckDB SQL for every checkable query (the correctness oracle)."""

from .queries import SQL as ORACLE_SQL

__all__ = ["ORACLE_SQL"]
