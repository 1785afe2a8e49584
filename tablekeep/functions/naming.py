"""Names of tables and artifacts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tablekeep.functions.times import day_stamp, stamp

# Name forms artifacts carry.
BACKUP_PREFIX = "backup_"
INCREMENTAL_PREFIX = "incremental_"
DUMP_SUFFIX = ".sql.gz"
SYSTEM_SCHEMAS = ("pg_catalog", "information_schema")


def qualified(schema: Column, table: Column) -> Column:
    """``schema.table``; NULL if either part is."""
    return F.concat(schema, F.lit("."), table)


def flat(name: Column) -> Column:
    """``schema_table`` for use in a file name."""
    return F.translate(name, ".", "_")


def backup_name(at: Column, suffix: str = DUMP_SUFFIX) -> Column:
    """``backup_20240315_120000.sql.gz``."""
    return F.concat(F.lit(BACKUP_PREFIX), stamp(at), F.lit(suffix))


def backup_name_for_day(day: Column, suffix: str = DUMP_SUFFIX) -> Column:
    """``backup_20240315.sql.gz``."""
    return F.concat(F.lit(BACKUP_PREFIX), day_stamp(day), F.lit(suffix))


def schema_backup_name(schema: Column, day: Column, suffix: str = DUMP_SUFFIX) -> Column:
    """``sales_20240315.sql.gz``."""
    return F.concat(schema, F.lit("_"), day_stamp(day), F.lit(suffix))


def incremental_name(table: Column, day: Column, suffix: str = DUMP_SUFFIX) -> Column:
    """``incremental_sales_orders_20240315.sql.gz`` for ``sales.orders``."""
    return F.concat(
        F.lit(INCREMENTAL_PREFIX), flat(table), F.lit("_"), day_stamp(day), F.lit(suffix)
    )


def base_name(path: Column) -> Column:
    """Part after the last slash."""
    return F.substring_index(path, "/", -1)


def without_extension(name: Column) -> Column:
    """Name without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(name, r"(?<=[^/.])\.[^./]*$", "")


def or_default(value: Column, default: str) -> Column:
    """``default`` where the value is missing or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))
