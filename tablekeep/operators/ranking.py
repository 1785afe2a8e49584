"""Numbering rows inside groups of which one may be huge.

A window over a whole group would sort it in one task. Here a group is cut into
slices of time. Figures per slice are few, so they can be put in order per group;
rows only ever meet the other rows of their slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SLICE = "__slice"


def with_slice(df: DataFrame, time: str, unit: str = "hour") -> DataFrame:
    """Rows with the slice of time they fall in."""
    return df.withColumn(SLICE, F.date_trunc(unit, F.col(time)).cast("timestamp_ntz"))


def since_last(
    df: DataFrame,
    group: str,
    time: str,
    tie_break: str,
    mark: Column,
    end: Column | None = None,
) -> DataFrame:
    """Rows from the last marked one of their group on; none of a group without a mark.

    Nor of a group in which an ``end`` comes after that. One aggregation finds the
    bounds, one row per group and task, and one join brings them back; Spark splits
    the rows of a huge group.
    """
    order = F.struct(F.col(time).alias("at"), F.col(tie_break).alias("tie"))
    last = F.max(F.when(mark, order)).alias("__last")
    ended = F.max(F.when(F.lit(False) if end is None else end, order)).alias("__ended")
    bounds = df.groupBy(group).agg(last, ended)
    bounds = bounds.where("__last IS NOT NULL AND NOT coalesce(__ended > __last, FALSE)")
    joined = df.join(bounds.select(group, "__last"), group)
    return joined.where(order >= F.col("__last")).select(*df.columns)


def number_in_order(
    df: DataFrame, group: str, time: str, tie_break: str, alias: str, unit: str = "hour"
) -> DataFrame:
    """Exact position (from 1) of each row within its group, by time and tie break.

    Rows are numbered within their slice; the counts per slice give the number
    each slice starts with.
    """
    sliced = with_slice(df, time, unit)
    slices = sliced.groupBy(group, SLICE).agg(F.count(F.lit(1)).alias("__n"))
    earlier = W.partitionBy(group).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    starts = slices.select(
        group, SLICE, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before")
    )
    inside = F.row_number().over(W.partitionBy(group, SLICE).orderBy(time, tie_break))
    return (
        sliced.join(starts, [group, SLICE])
        .withColumn(alias, F.col("__before") + inside)
        .select(*df.columns, alias)
    )
