"""Sketches of columns that can be merged: distinct values (HLL) and quantiles (KLL).

A copy's sketches are a few kilobytes a column. Those of many copies, batches or tables of one schema
are merged without reading any of them again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablekeep.functions.hashing import column_of, row_hash

HLL_BITS = 14  # a relative error of about 1 % in the number of distinct values
KLL_K = 800  # a rank error of about 0.4 % in quantiles
SKETCH = "column_name string, row_count bigint, non_null bigint, hll binary, kll binary"


def _is_number(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.DatetimeType)) and not isinstance(kind, T.DayTimeIntervalType)


def _number(value: Column, kind: T.DataType) -> Column:
    """What quantiles are taken of: numbers, days since the epoch, or microseconds."""
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("double")
    if isinstance(kind, T.DatetimeType):
        return F.unix_micros(value.cast("timestamp")).cast("double")
    return value.cast("double")


def sketches(df: DataFrame) -> DataFrame:
    """One row per column, from one pass over the table; see ``SKETCH``.

    ``kll`` is NULL for columns that are neither numbers nor times, and where there are no values.
    """
    columns = []
    for field in df.schema.fields:
        value, kind = column_of(field.name), field.dataType
        digest = F.when(value.isNotNull(), row_hash(T.StructType([field])))
        kll = F.kll_sketch_agg_double(_number(value, kind), F.lit(KLL_K)) if _is_number(kind) else F.lit(None)
        columns.append(
            F.struct(
                F.lit(field.name).alias("column_name"),
                F.count(F.lit(1)).alias("row_count"),
                F.count(value).alias("non_null"),
                F.hll_sketch_agg(digest, F.lit(HLL_BITS)).alias("hll"),
                F.when(F.count(value) > 0, kll).cast("binary").alias("kll"),
            )
        )
    wide = df.agg(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
    return wide.select(F.explode(F.array(*[f"c{i}" for i in range(len(columns))])).alias("c")).select("c.*")


def merged(parts: DataFrame) -> DataFrame:
    """The sketches of everything that ``parts`` are sketches of, column by column."""
    return parts.groupBy("column_name").agg(
        F.sum("row_count").alias("row_count"),
        F.sum("non_null").alias("non_null"),
        F.hll_union_agg("hll").alias("hll"),
        F.kll_merge_agg_double("kll").alias("kll"),
    )


def estimates(found: DataFrame, shares: list[float]) -> DataFrame:
    """Per column the distinct values and the quantiles at some shares, as ``quantiles``."""
    wanted = F.array(*[F.lit(float(s)) for s in shares])
    return found.select(
        "column_name",
        "row_count",
        "non_null",
        F.hll_sketch_estimate("hll").alias("distinct_count"),
        # of columns without numbers the merged sketch is there, but empty
        F.when(
            F.coalesce(F.kll_sketch_get_n_double("kll"), F.lit(0)) > 0,
            F.kll_sketch_get_quantile_double("kll", wanted),
        ).alias("quantiles"),
    )
