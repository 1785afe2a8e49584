"""Which artifacts to keep and which to let go."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from tablekeep.functions.times import (
    DEFAULT_RETENTION_DAYS,
    age_days,
    age_seconds,
    expired,
    moment,
)


def retention(
    artifacts: DataFrame,
    as_of: datetime | str,
    days: int = DEFAULT_RETENTION_DAYS,
    rule: str = "exact",
) -> DataFrame:
    """Every artifact with its age and whether it is out of retention."""
    now = moment(as_of)
    at = F.col("modified_at")
    return artifacts.select(
        "*",
        age_seconds(at, now).alias("age_seconds"),
        age_days(at, now).alias("age_days"),
        expired(at, as_of, days, rule).alias("expired"),
    )


def retention_plan(
    artifacts: DataFrame,
    as_of: datetime | str,
    days: int = DEFAULT_RETENTION_DAYS,
    rule: str = "exact",
    tie_break: str = "name",
) -> DataFrame:
    """:func:`retention` plus ``needed`` and ``removable``.

    An expired copy is still needed if it is

    - the newest copy of its table, or the newest full one, or
    - the full copy before a kept incremental one which no kept full copy precedes.

    Expiry only depends on age, so at most two copies per table can be needed,
    its newest and its newest expired full one, and a few bounds per table decide.
    They come from one aggregation; the copies are then found by their own
    (table, kind, time, tie break), a key on which no table's artifacts crowd
    together.
    """
    aged = retention(artifacts, as_of, days, rule)
    order = F.struct(
        F.col("modified_at").alias("at"), F.col(tie_break).alias("tie"), F.col("kind").alias("kind")
    )
    full, old = F.col("kind") == "full", F.col("expired")
    bounds = aged.groupBy("table_name").agg(
        F.max(order).alias("newest"),
        F.bool_and(old).alias("all_expired"),
        F.max(F.when(full & old, order)).alias("last_expired_full"),
        F.min(F.when(full & ~old, order)).alias("first_kept_full"),
        F.min(F.when(~full & ~old, order)).alias("first_kept_incremental"),
    )
    base_needed = F.col("first_kept_full").isNull() | F.coalesce(
        F.col("first_kept_incremental") < F.col("first_kept_full"), F.lit(False)
    )
    kept = F.array(
        F.when(F.col("all_expired"), F.col("newest")),
        F.when(base_needed, F.col("last_expired_full")),
    )
    needed = (
        bounds.select("table_name", F.explode(F.array_distinct(F.array_compact(kept))).alias("keep"))
        .select(
            "table_name",
            F.col("keep.kind").alias("kind"),
            F.col("keep.at").alias("modified_at"),
            F.col("keep.tie").alias(tie_break),
            F.lit(True).alias("__needed"),
        )
    )
    marked = aged.join(needed, ["table_name", "kind", "modified_at", tie_break], "left")
    is_needed = F.coalesce(F.col("__needed"), F.lit(False))
    return marked.select(
        *aged.columns,
        is_needed.alias("needed"),
        (F.col("expired") & ~is_needed).alias("removable"),
    )
