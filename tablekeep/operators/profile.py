"""Profiles and fingerprints of tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablekeep.functions.hashing import (
    column_of,
    fingerprint_parts,
    portable_row_hash,
    row_hash,
)

_PROFILE = (
    "column_name string, row_count bigint, non_null bigint, distinct_count bigint,"
    " min_text string, max_text string, sum_text string,"
    " min_number double, max_number double, sum_number double"
)


def _figures(field: T.StructField, sketch: bool) -> Column:
    """All figures of a column as one struct of aggregates."""
    value, kind = column_of(field.name), field.dataType
    none = F.lit(None)
    texts, numbers = [none] * 3, [none] * 3
    if isinstance(kind, (T.StringType, T.DatetimeType, T.BooleanType, T.IntegralType)):
        texts[:2] = F.min(value), F.max(value)
    if isinstance(kind, T.NumericType):
        whole = isinstance(kind, T.IntegralType)
        # Whole numbers are summed exactly; a bigint sum could overflow.
        total = F.sum(value.cast("decimal(28,0)")) if whole else F.sum(value)
        numbers = [F.min(value), F.max(value), total]
        texts[2] = total if whole else none
    hashed = value if _hashable(kind) else F.when(value.isNotNull(), _digest(field)[0])
    distinct = F.approx_count_distinct(hashed) if sketch else none
    values = [F.lit(field.name), F.count(F.lit(1)), F.count(value), distinct, *texts, *numbers]
    named = zip(values, (part.split() for part in _PROFILE.split(", ")))
    return F.struct(*[v.cast(to).alias(name) for v, (name, to) in named])


def _hashable(kind: T.DataType) -> bool:
    return isinstance(kind, T.AtomicType) and not isinstance(kind, T.VariantType)


def _digest(field: T.StructField) -> list[Column]:
    """128 bits that stand for a value."""
    own = T.StructType([field])
    return [row_hash(own), row_hash(own, salt=1)]


def _value_keys(field: T.StructField) -> list[Column]:
    """Two longs that stand for a value: itself, a one-to-one hash of 64 bits, or a digest."""
    value, kind = column_of(field.name), field.dataType
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return [value.cast("bigint"), F.lit(0).cast("bigint")]
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return [F.xxhash64(value.cast("double") + 0.0), F.lit(0).cast("bigint")]
    return _digest(field)


def _distinct_counts(df: DataFrame) -> DataFrame:
    """Exact distinct values of each column, in one pass and one shuffle for all of them.

    Every value is two longs, reduced to different ones in every task before they are sent.
    """
    values = [
        F.struct(F.lit(i).alias("i"), *[k.alias(f"d{n}") for n, k in enumerate(_value_keys(field))])
        for i, field in enumerate(df.schema.fields)
    ]
    present = [F.when(column_of(f.name).isNotNull(), v) for f, v in zip(df.schema.fields, values)]
    rows = df.select(F.explode(F.array(*present)).alias("v")).where("v IS NOT NULL")
    rows = rows.groupBy("v.i", "v.d0", "v.d1").agg(F.lit(1).alias("one"))
    names = F.array(*[F.lit(f.name) for f in df.schema.fields])
    counts = rows.groupBy("i").agg(F.count(F.lit(1)).alias("found"))
    return counts.select(F.get(names, F.col("i")).alias("name"), "found")


def table_profile(df: DataFrame, distinct: str = "approx") -> DataFrame:
    """One row per column: rows, non-null values, distinct values, bounds and sum.

    All figures come from one pass over the table, in which each task sends one
    row. Bounds and sums of whole numbers are exact in their ``_text`` columns.
    ``distinct`` is a sketch (``approx``), left out (``none``) or ``exact``: then
    the table is read once more and all columns are reduced to their values, long
    ones to 128-bit digests, in every task before one shuffle.
    """
    if distinct not in ("approx", "exact", "none"):
        raise ValueError("distinct is one of approx, exact, none")
    figures = [_figures(field, distinct == "approx") for field in df.schema.fields]
    wide = df.agg(*[f.alias(f"c{i}") for i, f in enumerate(figures)])
    long = F.explode(F.array(*[f"c{i}" for i in range(len(figures))])).alias("column")
    found = wide.select(long).select("column.*")
    if distinct != "exact":
        return found
    counts = _distinct_counts(df)
    joined = found.drop("distinct_count").join(counts, found.column_name == counts.name, "left")
    joined = joined.withColumn("distinct_count", F.coalesce("found", F.lit(0)))
    return joined.select(*found.columns)


def fingerprint(df: DataFrame, algorithm: str = "native", columns: list[str] | None = None) -> DataFrame:
    """One row (row_count, fingerprint): the content as a bag of rows.

    ``native`` hashes all columns of any type. ``portable`` hashes a text form
    which other engines can rebuild; columns without one (maps, structs, variants)
    raise unless ``columns`` names others.
    """
    if algorithm == "native":
        chosen = df.select(*[column_of(c) for c in columns]) if columns else df
        hashed = row_hash(chosen.schema)
    elif algorithm == "portable":
        names = columns or df.columns
        chosen = df.select(*[column_of(c) for c in names])
        hashed = portable_row_hash(df.schema, names)
    else:
        raise ValueError("algorithm is one of native, portable")
    return chosen.select(hashed.alias("hash64")).agg(*fingerprint_parts(F.col("hash64")))


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    """Union by name, joined pairwise so that the plan stays shallow."""
    frames = list(frames)
    while len(frames) > 1:
        frames = [
            frames[i].unionByName(frames[i + 1]) if i + 1 < len(frames) else frames[i]
            for i in range(0, len(frames), 2)
        ]
    return frames[0]


def table_fingerprints(tables: Mapping[str, DataFrame], algorithm: str = "native") -> DataFrame:
    """Fingerprints of several tables, one row each, in one job.

    The plan grows with the tables; for thousands use ``table_measures``, which
    runs a job per table.
    """
    return union_all(
        fingerprint(df, algorithm).select(F.lit(name).alias("table_name"), "*")
        for name, df in tables.items()
    )


def table_profiles(tables: Mapping[str, DataFrame], distinct: str = "approx") -> DataFrame:
    """Profiles of several tables in one job."""
    return union_all(
        table_profile(df, distinct).select(F.lit(name).alias("table_name"), "*")
        for name, df in tables.items()
    )
