"""Ranges of a key that hold about equally many rows, to split the read of a table by.

Bounds come from a quantile sketch of the key. A value that takes up a whole range by itself
has one of its own, so that no other rows wait for it.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from tablekeep.functions.hashing import column_of, quoted

ACCURACY = 100  # times the number of ranges: the sketch's rank error is one part in this many


@dataclass(frozen=True)
class KeyRange:
    """Keys above ``low`` and up to ``high`` (below it if ``open``); None is unbounded.

    ``only`` is a single value; a range of nothing but NULL has ``null``.
    """

    low: Any = None
    high: Any = None
    open: bool = False
    only: Any = None
    null: bool = False

    def predicate(self, name: str) -> str:
        """The range as SQL, for a column name as it is to be written."""
        if self.null:
            return f"{name} IS NULL"
        if self.only is not None:
            return f"{name} = {literal(self.only)}"
        parts = [] if self.low is None else [f"{name} > {literal(self.low)}"]
        if self.high is not None:
            parts.append(f"{name} {'<' if self.open else '<='} {literal(self.high)}")
        return " AND ".join(parts) or f"{name} IS NOT NULL"


def literal(value: Any) -> str:
    if isinstance(value, datetime):
        return f"TIMESTAMP '{value.isoformat(sep=' ')}'"
    if isinstance(value, date):
        return f"DATE '{value.isoformat()}'"
    return repr(value) if isinstance(value, float) else str(value)


def equi_depth(df: DataFrame, key: str, parts: int) -> list[KeyRange]:
    """Ranges that cover every row once, from one pass over the key alone.

    The key is a number, a date or a time. Empty tables have one range.
    """
    if parts < 1:
        raise ValueError("parts must be a positive whole number")
    value = column_of(key)
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)]) if parts > 1 else F.array(F.lit(1.0))
    bounds, nulls = df.agg(
        F.percentile_approx(value, shares, F.lit(ACCURACY * parts)), F.count_if(value.isNull())
    ).first()
    found, low = [], None
    bounds = list(bounds or []) if parts > 1 else []
    for bound in sorted(set(bounds)):
        if bounds.count(bound) > 1:  # more than a range's share
            found += [KeyRange(low=low, high=bound, open=True), KeyRange(only=bound)]
        else:
            found.append(KeyRange(low=low, high=bound))
        low = bound
    found.append(KeyRange(low=low))
    return found + [KeyRange(null=True)] * bool(nulls)


def range_of(key: str, ranges: list[KeyRange]) -> Column:
    """The number of the range a row is in."""
    chosen = F
    for number, one in enumerate(ranges):
        chosen = chosen.when(F.expr(one.predicate(quoted(key))), number)
    return chosen


def range_counts(df: DataFrame, key: str, ranges: list[KeyRange]) -> DataFrame:
    """(number, predicate, row_count) of the ranges that hold rows."""
    names = F.array(*[F.lit(r.predicate(quoted(key))) for r in ranges])
    counted = df.groupBy(range_of(key, ranges).alias("number")).agg(F.count(F.lit(1)).alias("row_count"))
    return counted.select("number", F.get(names, F.col("number")).alias("predicate"), "row_count")
