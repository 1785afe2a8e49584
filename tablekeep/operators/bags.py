"""Tables as signed bags: what changed, with how many copies of a row came or went, and its undoing.

A delta holds a table's columns and ``copies``, above zero for rows that came and below for rows
that went. Deltas of a chain add up, so that a chain of any length is folded in one aggregation, and
only rows that it takes away have to be looked for in the table it starts from.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablekeep.functions.hashing import column_of, free_name, row_hash
from tablekeep.operators.change import net_changes


def is_groupable(data_type: T.DataType) -> bool:
    """Whether rows with such a value can be put together by content."""
    if isinstance(data_type, T.StructType):
        return all(is_groupable(f.dataType) for f in data_type.fields)
    if isinstance(data_type, T.ArrayType):
        return is_groupable(data_type.elementType)
    return not isinstance(data_type, (T.MapType, T.VariantType))


def copies_column(names: Sequence[str]) -> str:
    """The column of signed counts: ``copies`` unless the table has one."""
    low, name = {n.lower() for n in names}, "copies"
    while name in low:
        name += "_"
    return name


def delta_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(copies_column(schema.names), T.LongType())])


def signed_delta(
    old: DataFrame, new: DataFrame, deltas: Sequence[DataFrame] = (), method: str = "digest"
) -> DataFrame:
    """What makes the new version of a table out of the old one and the deltas that follow it.

    All are added up as signed rows at once, so the chain need not be folded first; ``method`` is
    that of :func:`row_delta`.
    """
    names = {name: f"c{i}" for i, name in enumerate(old.columns)}
    copies, rows = copies_column(list(names)), [column_of(name) for name in names]
    known = [old.select(*rows, F.lit(-1).cast("bigint")), new.select(*rows, F.lit(1).cast("bigint"))]
    known += [delta.select(*rows, -column_of(copies)) for delta in deltas]
    signed = reduce(DataFrame.unionAll, known).toDF(*names.values(), "sign")
    found = net_changes(signed, list(names.values()), "sign", method)
    signs = F.when(F.col("change") == "inserted", F.col("copies")).otherwise(-F.col("copies"))
    columns = [F.col(own).alias(name) for name, own in names.items()]
    return found.select(*columns, signs.cast("bigint").alias(copies))


def _repeated(rows: DataFrame, copies: str, columns: Sequence[Column]) -> DataFrame:
    """Each row as often as its column of counts says."""
    number = free_name([*rows.columns], "number")
    times = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(copies))).alias(number)
    return rows.where(F.col(copies) > 0).select("*", times).select(*columns)


def folded(base: DataFrame, deltas: Sequence[DataFrame]) -> DataFrame:
    """A table after a chain of deltas.

    The chain's counts are added up first. Rows of the base pass as they are unless the chain takes
    some of their copies away; these are found by 128-bit digests and counted by content.
    """
    if not deltas:
        return base
    names, copies = base.columns, copies_column(base.columns)
    own = {k: free_name([*names, copies], k) for k in ("d1", "d2")}
    digests = {own["d1"]: row_hash(base.schema), own["d2"]: row_hash(base.schema, salt=1)}
    columns, keys = [column_of(name) for name in names], list(own.values())
    added = F.sum(copies).alias(copies)
    net = reduce(DataFrame.unionAll, deltas).groupBy(*columns).agg(added)
    come = _repeated(net, copies, columns)
    go = net.where(F.col(copies) < 0).withColumns(digests)
    marked, lost = base.withColumns(digests), go.select(*keys).distinct()
    stay = marked.join(lost, keys, "left_anti").select(*columns)
    one = marked.join(lost, keys, "left_semi").select(*columns, F.lit(1).cast("bigint").alias(copies))
    rest = one.unionAll(go.drop(*keys)).groupBy(*columns).agg(added)
    return stay.unionAll(_repeated(rest, copies, columns)).unionAll(come)
