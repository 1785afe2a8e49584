"""Which tables belong to a run."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from tablekeep.functions.naming import SYSTEM_SCHEMAS, qualified


def name_list(names: str | Iterable[str] | None) -> list[str]:
    """Names from a comma-separated text or any iterable, blanks dropped."""
    if names is None:
        return []
    parts = names.split(",") if isinstance(names, str) else names
    return [p.strip() for p in parts if p.strip()]


def _matches(names: list[str]):
    """A table is named by itself or as ``schema.table``."""
    return F.col("table_name").isin(names) | F.col("qualified_name").isin(names)


def select_tables(
    tables: DataFrame,
    schemas: str | Iterable[str] | None = None,
    exclude_schemas: str | Iterable[str] | None = None,
    only: str | Iterable[str] | None = None,
    exclude: str | Iterable[str] | None = None,
    system_schemas: Iterable[str] = SYSTEM_SCHEMAS,
) -> DataFrame:
    """The tables of a run, with ``qualified_name``.

    System schemas never belong to it. An empty include list includes all, and
    exclusion wins over inclusion. Rows without a schema or table name drop out.
    """
    chosen = tables.select(
        "schema_name",
        "table_name",
        qualified(F.col("schema_name"), F.col("table_name")).alias("qualified_name"),
    ).where(
        F.col("qualified_name").isNotNull() & ~F.col("schema_name").isin(list(system_schemas))
    )
    if wanted := name_list(schemas):
        chosen = chosen.where(F.col("schema_name").isin(wanted))
    if unwanted := name_list(exclude_schemas):
        chosen = chosen.where(~F.col("schema_name").isin(unwanted))
    if wanted := name_list(only):
        chosen = chosen.where(_matches(wanted))
    if unwanted := name_list(exclude):
        chosen = chosen.where(~_matches(unwanted))
    return chosen


def count_by_schema(selected: DataFrame) -> DataFrame:
    """How many tables of the run each schema holds."""
    return selected.groupBy("schema_name").agg(F.count(F.lit(1)).alias("tables"))
