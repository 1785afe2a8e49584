"""The test tables and the artifact catalogue the queries run on."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablekeep.functions.times import stamp
from tablekeep.sources.tables import ParquetTables

# Columns of the test tables. i integer, d double, s string,
# t timestamp, a array.
COLUMNS = {
    "benchmark": "item_id:i text:s",
    "conversations": "conv_id:i turn:i role:s text:s",
    "customer": "c_custkey:i c_name:s c_nationkey:i c_acctbal:d c_mktsegment:s",
    "documents": "doc_id:i text:s lang:s source:s n_chars:i",
    "embeddings": "vec_id:i embedding:a label:i",
    "events": "event_id:i ts:t user_id:i event_type:s value:d props:s",
    "labels": "doc_id:i quality:i toxic:i",
    "lineitem": "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:d"
    " l_extendedprice:d l_discount:d l_tax:d l_returnflag:s l_linestatus:s l_shipdate:t",
    "nation": "n_nationkey:i n_name:s n_regionkey:i",
    "orders": "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:d o_orderdate:t"
    " o_orderpriority:s",
    "pages": "page_id:i url:s html:s",
    "part": "p_partkey:i p_name:s p_brand:s p_type:s p_size:i p_retailprice:d",
    "region": "r_regionkey:i r_name:s",
    "supplier": "s_suppkey:i s_name:s s_nationkey:i s_acctbal:d",
}
TABLES = sorted(COLUMNS)

# Schemas the tables are put in where a query needs more than one.
SCHEMAS = {
    "benchmark": "corpus",
    "conversations": "corpus",
    "customer": "sales",
    "documents": "corpus",
    "embeddings": "corpus",
    "events": "sales",
    "labels": "corpus",
    "lineitem": "sales",
    "nation": "shared",
    "orders": "sales",
    "pages": "corpus",
    "part": "sales",
    "region": "shared",
    "supplier": "sales",
}

RETENTION_AS_OF = datetime(2024, 2, 15)
CHAIN_AS_OF = datetime(2024, 1, 20)


def columns(table: str) -> list[tuple[str, str]]:
    return [tuple(part.split(":")) for part in COLUMNS[table].split()]


def source(spark: SparkSession, folder: str) -> ParquetTables:
    return ParquetTables(spark, folder, SCHEMAS)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as an artifact: type is the table, time the time of writing."""
    return table(spark, folder, "events").select(
        F.col("event_type").alias("table_name"),
        F.concat(F.lit("backup_"), stamp(F.col("ts")), F.lit("_"), F.col("event_id")).alias("name"),
        F.col("ts").alias("modified_at"),
        F.round(F.col("value") * 100).cast("bigint").alias("size_bytes"),
        F.when(F.col("event_id") % 7 == 0, "full").otherwise("incremental").alias("kind"),
        "event_id",
    )


ARTIFACTS_SQL = """WITH art AS (
  SELECT event_type AS table_name,
         concat('backup_', strftime(ts, '%Y%m%d_%H%M%S'), '_', event_id) AS name,
         ts AS modified_at,
         CAST(round(value * 100) AS BIGINT) AS size_bytes,
         CASE WHEN event_id % 7 = 0 THEN 'full' ELSE 'incremental' END AS kind,
         event_id
  FROM events
)"""


def readable_sql(size: str) -> str:
    """SQL for a byte count with its unit, two decimals rounded half up."""
    cases = []
    for unit, power in (("PB", 5), ("TB", 4), ("GB", 3), ("MB", 2), ("KB", 1)):
        one = 1024**power
        cents = f"((CAST({size} AS HUGEINT) * 200 + {one}) // {2 * one})"
        cases.append(
            f"WHEN {size} >= {one} THEN concat({cents} // 100, '.',"
            f" lpad(CAST({cents} % 100 AS VARCHAR), 2, '0'), ' {unit}')"
        )
    return f"CASE {' '.join(cases)} ELSE concat({size}, ' B') END"
