"""Queries on whole tables: profile, fingerprint, selection, change."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablekeep.functions.hashing import (
    DOUBLE_BITS,
    DOUBLE_CENTS,
    DOUBLE_ROOM,
    DOUBLE_STEP,
    DOUBLE_STEPS,
)
from tablekeep.operators import change, profile, ranges, selection
from tablekeep.plans.snapshot import table_measures
from tablekeep.queries.common import SCHEMAS, TABLES, columns, source, table


def table_profile(spark: SparkSession, folder: str) -> DataFrame:
    tables = {name: table(spark, folder, name) for name in TABLES}
    return profile.table_profiles(tables, distinct="exact").withColumn(
        "sum_number", F.round("sum_number", 2)
    )


def _profile_sql(distinct: bool = True) -> str:
    selects = []
    for name in TABLES:
        for column, kind in columns(name):
            text = "CAST({}({c}) AS VARCHAR)" if kind in "sti" else "CAST(NULL AS VARCHAR)"
            number = "CAST({}({c}) AS DOUBLE)" if kind in "id" else "CAST(NULL AS DOUBLE)"
            total = "round(CAST(sum({c}) AS DOUBLE), 2)" if kind in "id" else "CAST(NULL AS DOUBLE)"
            whole = "CAST(sum({c}) AS VARCHAR)" if kind == "i" else "CAST(NULL AS VARCHAR)"
            count = f"count(DISTINCT {column})" if distinct else "CAST(NULL AS BIGINT)"
            selects.append(
                f"SELECT '{name}' AS table_name, '{column}' AS column_name,"
                f" count(*) AS row_count, count({column}) AS non_null,"
                f" {count} AS distinct_count,"
                f" {text.format('min', c=column)} AS min_text,"
                f" {text.format('max', c=column)} AS max_text,"
                f" {whole.format(c=column)} AS sum_text,"
                f" {number.format('min', c=column)} AS min_number,"
                f" {number.format('max', c=column)} AS max_number,"
                f" {total.format(c=column)} AS sum_number FROM {name}"
            )
    return "\nUNION ALL ".join(selects)


def table_profile_one_pass(spark: SparkSession, folder: str) -> DataFrame:
    """The profile without distinct counts: one scan for each table."""
    tables = {name: table(spark, folder, name) for name in TABLES}
    return profile.table_profiles(tables, distinct="none").withColumn(
        "sum_number", F.round("sum_number", 2)
    )


def _double_sql(x: str) -> str:
    """SQL for the text of a double, see ``functions.hashing``."""
    x = f"CAST({x} AS DOUBLE)"
    powers, values = [], []
    for step in range(-DOUBLE_STEPS, DOUBLE_STEPS + 1):
        when = "ELSE"
        if step < DOUBLE_STEPS:
            bound = 2.0 ** (DOUBLE_STEP * step + DOUBLE_ROOM)
            when = f"WHEN abs({x}) < CAST('{bound!r}' AS DOUBLE) THEN"
        powers.append(f"{when} {step}")
        values.append(f"{when} {x} * CAST('{2.0 ** (-DOUBLE_STEP * step)!r}' AS DOUBLE)")
    power, y = f"(CASE {' '.join(powers)} END)", f"(CASE {' '.join(values)} END)"
    bits = f"CAST('{2.0**DOUBLE_BITS!r}' AS DOUBLE)"
    rest = f"(({y} - trunc({y})) * {bits})"
    third = f"(({rest} - trunc({rest})) * {bits})"
    whole = [f"CAST(trunc({v}) AS BIGINT)" for v in (y, rest, third)]
    cents = f"floor({x} * 100 + 0.5)"
    return (
        f"CASE WHEN {x} IS NULL THEN NULL"
        f" WHEN abs({x}) < {2**DOUBLE_CENTS} AND {cents} / 100 = {x}"
        f" THEN concat('c', CAST({cents} AS BIGINT))"
        f" ELSE concat_ws('/', {power}, {', '.join(whole)}) END"
    )


def marked_sql(text: str) -> str:
    return f"coalesce(length({text}) || ':' || {text}, 'N')"


def _array_sql(array: str, text) -> str:
    each = f"list_transform({array}, lambda e: {marked_sql(text('e'))})"
    return f"concat(len({array}), '[', array_to_string({each}, ''))"


def table_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return portable_fingerprints({name: table(spark, folder, name) for name in TABLES})


def portable_sql(name: str, rows: str | None = None, shown: str | None = None) -> str:
    """SQL for the portable fingerprint of rows with the columns of a table, the table's by default."""
    parts = []
    for column, kind in columns(name):
        text = f"CAST({'epoch_us(' + column + ')' if kind == 't' else column} AS VARCHAR)"
        if kind == "d":
            text = f"({_double_sql(column)})"
        elif kind == "a":
            text = _array_sql(column, lambda e: f"({_double_sql(e)})")
        parts.append(marked_sql(text))
    return sum_sql(f"({rows})" if rows else name, parts, f"'{shown or name}' AS table_name, ")


def _fingerprint_sql() -> str:
    return "\nUNION ALL ".join(portable_sql(name) for name in TABLES)


def portable_fingerprints(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The content of tables as other engines can compute it: (table_name, row_count, fingerprint)."""
    return profile.table_fingerprints(tables, "portable").withColumn(
        "fingerprint", F.col("fingerprint").cast("string")
    )


def sum_sql(table_sql: str, parts: list[str], first: str = "") -> str:
    return (
        f"SELECT {first}count(*) AS row_count, CAST(sum("
        f"CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END"
        f") AS VARCHAR) AS fingerprint FROM ("
        f"SELECT CAST(CAST('0x' || substr(md5({' || '.join(parts)}), 1, 16) AS UBIGINT)"
        f" AS HUGEINT) AS h FROM {table_sql})"
    )


def fingerprint_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """The portable fingerprint of the documents' words as arrays, with commas and NULL in them."""
    words = F.transform(
        F.split("text", " "), lambda w: F.when(F.length(w) % 5 != 0, w)
    )
    rows = table(spark, folder, "documents").select("doc_id", words.alias("words"))
    return profile.fingerprint(rows, "portable").withColumn(
        "fingerprint", F.col("fingerprint").cast("string")
    )


def fingerprint_native(spark: SparkSession, folder: str) -> DataFrame:
    """The native fingerprint of every table and of a shuffled copy with its columns' hashes."""
    tables = {name: table(spark, folder, name) for name in TABLES}
    found = profile.table_fingerprints(tables)
    dealt = {name: df.repartition(7) for name, df in tables.items()}
    again = profile.table_fingerprints(dealt).withColumnRenamed("fingerprint", "other")
    same = F.col("fingerprint") == F.col("other")
    return found.join(again, ["table_name", "row_count"]).select(
        "table_name", "row_count", same.alias("same")
    )


_ARRAYS_SQL = sum_sql(
    "(SELECT doc_id, list_transform(string_split(text, ' '),"
    " lambda w: CASE WHEN length(w) % 5 <> 0 THEN w END) AS words FROM documents)",
    [marked_sql("CAST(doc_id AS VARCHAR)"), marked_sql(_array_sql("words", str))],
)
_NATIVE_SQL = "\nUNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS row_count, TRUE AS same FROM {name}" for name in TABLES
)


def table_set(spark: SparkSession, folder: str) -> DataFrame:
    """The tables of two schemas, without one of them, and their rows."""
    tables = source(spark, folder)
    chosen = selection.select_tables(
        tables.tables(), schemas="sales,shared", exclude="sales.supplier"
    )
    measured = table_measures(tables, chosen)
    return chosen.join(measured, ["schema_name", "table_name"]).select(
        "schema_name", "table_name", "qualified_name", "row_count"
    )


TABLE_SET_SQL = "\nUNION ALL ".join(
    f"SELECT '{SCHEMAS[name]}' AS schema_name, '{name}' AS table_name,"
    f" '{SCHEMAS[name]}.{name}' AS qualified_name, count(*) AS row_count FROM {name}"
    for name in TABLES
    if SCHEMAS[name] in ("sales", "shared") and name != "supplier"
)


def _named_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Brand and product name of every part, read as schema and table."""
    parts = table(spark, folder, "part")
    return parts.select(
        F.col("p_brand").alias("schema_name"), F.col("p_name").alias("table_name")
    ).distinct()


_PART_SELECTION = {
    "system_schemas": ("Brand#1", "Brand#2"),
    "exclude_schemas": "Brand#3, Brand#4",
    "exclude": ["Brand#5.red widget", "blue bolt"],
}
_PART_SELECTION_SQL = """
  SELECT DISTINCT p_brand AS schema_name, p_name AS table_name,
         p_brand || '.' || p_name AS qualified_name
  FROM part
  WHERE p_brand NOT IN ('Brand#1', 'Brand#2') AND p_brand NOT IN ('Brand#3', 'Brand#4')
    AND p_name <> 'blue bolt' AND NOT (p_brand = 'Brand#5' AND p_name = 'red widget')
"""


def select_tables(spark: SparkSession, folder: str) -> DataFrame:
    return selection.select_tables(_named_parts(spark, folder), **_PART_SELECTION)


def select_tables_by_schema(spark: SparkSession, folder: str) -> DataFrame:
    return selection.count_by_schema(select_tables(spark, folder))


def table_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Per user, as if a table, the newest error and the newest signup over 100."""

    def newest(event_type: str):
        wanted = (F.col("event_type") == event_type) & (F.col("value") > 100)
        return F.max(F.when(wanted, F.col("ts")))

    return (
        table(spark, folder, "events")
        .groupBy("user_id")
        .agg(newest("error").alias("last_analyze"), newest("signup").alias("last_autoanalyze"))
        .select(
            F.lit("users").alias("schema_name"),
            F.concat(F.lit("user_"), F.col("user_id")).alias("table_name"),
            "last_analyze",
            "last_autoanalyze",
        )
    )


def changed_since(spark: SparkSession, folder: str) -> DataFrame:
    return change.changed_since(table_stats(spark, folder), "2024-01-25 00:00:00")


CHANGED_SINCE_SQL = """
SELECT 'users' AS schema_name, concat('user_', user_id) AS table_name,
       last_analyze, last_autoanalyze, concat('users.user_', user_id) AS qualified_name
FROM (
  SELECT user_id,
         max(ts) FILTER (WHERE event_type = 'error' AND value > 100) AS last_analyze,
         max(ts) FILTER (WHERE event_type = 'signup' AND value > 100) AS last_autoanalyze
  FROM events GROUP BY user_id
)
WHERE last_analyze > TIMESTAMP '2024-01-25 00:00:00'
   OR last_autoanalyze > TIMESTAMP '2024-01-25 00:00:00'
"""


def old_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem")


def new_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """Line items after returns were booked, discounted copies added, small ones dropped."""
    old = old_lineitem(spark, folder)
    booked = old.withColumn(
        "l_returnflag",
        F.when(F.col("l_shipdate") >= F.lit("2001-01-01").cast("timestamp_ntz"), "X").otherwise(
            F.col("l_returnflag")
        ),
    )
    kept = booked.where("NOT (l_quantity < 3 AND l_linestatus = 'F')")
    return kept.unionAll(old.where("l_discount = 0.1 AND l_returnflag = 'A'"))


OLD_LINEITEM_SQL = "SELECT * FROM lineitem"
NEW_LINEITEM_SQL = """
  SELECT * REPLACE (CASE WHEN l_shipdate >= TIMESTAMP '2001-01-01' THEN 'X'
                         ELSE l_returnflag END AS l_returnflag)
  FROM lineitem WHERE NOT (l_quantity < 3 AND l_linestatus = 'F')
  UNION ALL
  SELECT * FROM lineitem WHERE l_discount = 0.1 AND l_returnflag = 'A'
"""


def row_delta(spark: SparkSession, folder: str) -> DataFrame:
    return change.row_delta(old_lineitem(spark, folder), new_lineitem(spark, folder))


def row_delta_digest(spark: SparkSession, folder: str) -> DataFrame:
    old, new = old_lineitem(spark, folder), new_lineitem(spark, folder)
    return change.row_delta(old, new, "digest")


def delta_sql(old: str, new: str) -> str:
    return f"""
WITH old AS ({old}), new AS ({new})
SELECT 'inserted' AS change, count(*) AS copies, * FROM
  (SELECT * FROM new EXCEPT ALL SELECT * FROM old) GROUP BY ALL
UNION ALL
SELECT 'deleted' AS change, count(*) AS copies, * FROM
  (SELECT * FROM old EXCEPT ALL SELECT * FROM new) GROUP BY ALL
"""


def new_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents after long ones were marked and one language was taken out."""
    old = table(spark, folder, "documents")
    marked = F.when(F.col("n_chars") > 2000, F.concat(F.col("text"), F.lit("\n.")))
    return old.where("lang <> 'fr'").withColumn("text", F.coalesce(marked, F.col("text")))


def row_delta_documents(spark: SparkSession, folder: str) -> DataFrame:
    return change.row_delta(table(spark, folder, "documents"), new_documents(spark, folder))


NEW_DOCUMENTS_SQL = """
  SELECT * REPLACE (CASE WHEN n_chars > 2000 THEN text || chr(10) || '.' ELSE text END AS text)
  FROM documents WHERE lang <> 'fr'
"""

_RANGES = 16


def key_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Ranges of the order key: whether each holds a sixteenth of the rows, give or take a tenth."""
    lines = table(spark, folder, "lineitem")
    counts = ranges.range_counts(lines, "l_orderkey", ranges.equi_depth(lines, "l_orderkey", _RANGES))
    total = lines.agg(F.count(F.lit(1)).alias("total"))
    share = F.col("row_count") * _RANGES / F.col("total")
    return counts.join(total).select(
        F.col("number").cast("bigint").alias("number"), share.between(0.9, 1.1).alias("balanced"), "total"
    )


def key_ranges_hot(spark: SparkSession, folder: str) -> DataFrame:
    """Ranges of a key of few values: each of them stands alone."""
    lines = table(spark, folder, "lineitem")
    found = ranges.equi_depth(lines, "l_linenumber", _RANGES)
    return ranges.range_counts(lines, "l_linenumber", found).select("predicate", "row_count")


_RANGES_SQL = f"""
SELECT number, TRUE AS balanced, (SELECT count(*) FROM lineitem) AS total
FROM range(0, {_RANGES}) AS numbers(number)
"""
_HOT_SQL = """
SELECT concat('`l_linenumber` = ', l_linenumber) AS predicate, count(*) AS row_count
FROM lineitem GROUP BY l_linenumber
"""

QUERIES = {
    "key_ranges": (key_ranges, _RANGES_SQL),
    "key_ranges_hot": (key_ranges_hot, _HOT_SQL),
    "table_profile_one_pass": (table_profile_one_pass, _profile_sql(False)),
    "table_profile": (table_profile, _profile_sql()),
    "table_fingerprint": (table_fingerprint, _fingerprint_sql()),
    "fingerprint_arrays": (fingerprint_arrays, _ARRAYS_SQL),
    "fingerprint_native": (fingerprint_native, _NATIVE_SQL),
    "table_set": (table_set, TABLE_SET_SQL),
    "select_tables": (select_tables, _PART_SELECTION_SQL),
    "select_tables_by_schema": (
        select_tables_by_schema,
        f"SELECT schema_name, count(*) AS tables FROM ({_PART_SELECTION_SQL}) GROUP BY 1",
    ),
    "changed_since": (changed_since, CHANGED_SINCE_SQL),
    "row_delta": (row_delta, delta_sql(OLD_LINEITEM_SQL, NEW_LINEITEM_SQL)),
    "row_delta_digest": (row_delta_digest, delta_sql(OLD_LINEITEM_SQL, NEW_LINEITEM_SQL)),
    "row_delta_documents": (
        row_delta_documents,
        delta_sql("SELECT * FROM documents", NEW_DOCUMENTS_SQL),
    ),
}
