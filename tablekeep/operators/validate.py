"""Whether dump text holds what a restore needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# The text a dump must hold, for table definitions and for data.
SCHEMA_MARKER = "CREATE TABLE"
DATA_MARKER = "COPY"


def text_markers(
    lines: DataFrame,
    key: str = "name",
    text: str = "value",
    schema_marker: str = SCHEMA_MARKER,
    data_marker: str = DATA_MARKER,
) -> DataFrame:
    """Per artifact, whether any of its lines holds either marker.

    Lines are reduced to two flags per artifact in each task before the shuffle.
    """
    value = F.col(text)
    return (
        lines.groupBy(key)
        .agg(
            F.bool_or(value.contains(schema_marker)).alias("has_schema"),
            F.bool_or(value.contains(data_marker)).alias("has_data"),
        )
    )


def validate_artifacts(
    listing: DataFrame,
    lines: DataFrame,
    key: str = "name",
    text: str = "value",
    schema_marker: str = SCHEMA_MARKER,
    data_marker: str = DATA_MARKER,
) -> DataFrame:
    """Every listed artifact with its markers; ``valid`` needs both.

    An empty artifact has no lines at all, so it comes in from the listing and
    is not valid.
    """
    found = text_markers(lines, key, text, schema_marker, data_marker)
    has_schema = F.coalesce(F.col("has_schema"), F.lit(False))
    has_data = F.coalesce(F.col("has_data"), F.lit(False))
    return (
        listing.select(key)
        .join(found, key, "left")
        .select(
            key,
            has_schema.alias("has_schema"),
            has_data.alias("has_data"),
            (has_schema & has_data).alias("valid"),
        )
    )


def publishable(validation: DataFrame) -> DataFrame:
    """The artifacts that may be published."""
    return validation.where("valid")
