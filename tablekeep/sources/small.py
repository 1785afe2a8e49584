"""Small DataFrames from rows the driver holds: table sets, manifests, reports."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema


def plain_rows(rows: Iterable[dict | tuple], names: list[str]) -> list[dict]:
    """Rows as dicts with exactly these keys."""
    return [
        {n: row.get(n) for n in names} if isinstance(row, dict) else dict(zip(names, row))
        for row in rows
    ]


def small_frame(spark: SparkSession, rows: Iterable[dict | tuple], ddl: str) -> DataFrame:
    """Rows as dicts (missing keys are NULL) or tuples, one per table or copy.

    Goes through Arrow, which needs no Python worker to be started.
    """
    schema = T.StructType.fromDDL(ddl)
    table = pa.Table.from_pylist(plain_rows(rows, schema.names), schema=to_arrow_schema(schema))
    return spark.createDataFrame(table, schema)
