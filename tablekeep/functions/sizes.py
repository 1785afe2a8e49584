"""Byte counts for people, in whole-number arithmetic (no float rounding)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Units and their powers of 1024.
UNITS = (("KB", 1), ("MB", 2), ("GB", 3), ("TB", 4), ("PB", 5))


def in_unit(size_bytes: Column, unit: str) -> Column:
    """Text with two decimals, rounded half up, such as ``1.50`` for 1536 in KB."""
    power = dict(UNITS)[unit]
    one = F.lit(1024**power).cast("decimal(38,0)")
    # hundredths = floor((bytes * 200 + unit) / (2 * unit))
    hundredths = F.call_function(
        "div", size_bytes.cast("decimal(20,0)") * F.lit(200) + one, one * F.lit(2)
    )
    return F.concat(
        F.call_function("div", hundredths, F.lit(100)).cast("string"),
        F.lit("."),
        F.lpad((hundredths % F.lit(100)).cast("string"), 2, "0"),
    )


def readable(size_bytes: Column) -> Column:
    """``512 B``, ``1.50 KB``, ``3.00 GB``."""
    text = F.concat(size_bytes.cast("string"), F.lit(" B"))
    for unit, power in UNITS:
        text = F.when(
            size_bytes >= F.lit(1024**power).cast("bigint"),
            F.concat(in_unit(size_bytes, unit), F.lit(" " + unit)),
        ).otherwise(text)
    return text
