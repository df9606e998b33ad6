"""Metadata mined from a JSON block comment in the statement text (D4) and the client label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import first_block_comment, json_string_map

# Keys read from the comment, in report order, and the label texts.
COMMENT_KEYS = [
    "app",
    "node_id",
    "profile_name",
    "target_name",
    "connection_name",
    "dbt_version",
    "dbt_databricks_version",
]
TOOL_APP = "dbt"
TOOL_CLIENT_PATTERN = "%dbt%"
TOOL_LABEL = "DBT Query"
OTHER_LABEL = "Other Query Type"

COMMENT_TEXT = "dbt_metadata_json"
COMMENT_MAP = "parsed_dbt_comment"
LABEL = "DBT_Query_Type"
METADATA_COLUMNS = [LABEL, *COMMENT_KEYS, COMMENT_MAP, "node_or_connection"]


def with_comment_text(df: DataFrame, text_col: str = "statement_text") -> DataFrame:
    """Body of the first ``/* ... */`` of each statement ('' when there is none)."""
    return df.withColumn(COMMENT_TEXT, first_block_comment(text_col))


def with_comment_metadata(df: DataFrame, missing: str | None = None) -> DataFrame:
    """Parse the comment once to ``map<string,string>`` and read every key from the map.

    ``missing`` fills absent keys (None keeps NULL, the other report uses ``'None'``).
    ``node_or_connection`` is ``node_id``, else ``connection_name``.
    """
    parsed = json_string_map(COMMENT_TEXT)
    df = df.withColumn(COMMENT_MAP, parsed)
    m = F.col(COMMENT_MAP)

    def fill(c):
        return c if missing is None else F.coalesce(c, F.lit(missing))

    fields = {k: fill(m[k]) for k in COMMENT_KEYS}
    fields["node_or_connection"] = fill(F.coalesce(m["node_id"], m["connection_name"]))
    return df.withColumns(fields)


def with_client_label(
    df: DataFrame,
    app: str = TOOL_APP,
    client_pattern: str = TOOL_CLIENT_PATTERN,
    label: str = TOOL_LABEL,
    other: str = OTHER_LABEL,
) -> DataFrame:
    """The tool label when the comment's ``app`` equals ``app`` (case-folded) or the
    client name matches ``client_pattern`` (case-sensitive LIKE); otherwise ``other``."""
    is_tool = (F.lower(F.col(COMMENT_MAP)["app"]) == F.lit(app)) | F.col("client_application").like(client_pattern)
    return df.withColumn(LABEL, F.when(is_tool, label).otherwise(other))
