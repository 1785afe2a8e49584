"""Queries that take snapshots of the test tables and read them back."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablekeep.functions.hashing import free_name
from tablekeep.operators import change, selection
from tablekeep.operators.catalogue import from_manifest, restore_points, snapshots
from tablekeep.operators.profile import table_profiles, union_all
from tablekeep.operators.sketches import estimates, merged
from tablekeep.plans import restore
from tablekeep.plans.copies import (
    changed_buckets,
    copy_delta,
    copy_sketches,
    differing_parts,
    schema_of,
)
from tablekeep.plans.manifest import copies_as_of, read_manifest
from tablekeep.plans.rotation import retention_apply as apply_retention
from tablekeep.plans.snapshot import (
    SnapshotOptions,
    snapshot_full as take_full,
    snapshot_incremental as take_incremental,
    snapshot_schemas,
    table_measures,
)
from tablekeep.plans.workflow import back_up, restore_snapshot
from tablekeep.queries.common import SCHEMAS, TABLES, columns, source, table
from tablekeep.queries.tables import (
    NEW_LINEITEM_SQL,
    delta_sql,
    marked_sql,
    new_lineitem,
    portable_fingerprints,
    portable_sql,
    sum_sql,
)
from tablekeep.session import scratch_folder
from tablekeep.sources import files
from tablekeep.sources.small import small_frame
from tablekeep.sources.tables import CatalogTables, FrameTables, ParquetTables, TableSource
from tablekeep.streaming.incremental import (
    append_batches,
    appended_rows,
    appended_table,
    new_files,
)

DAY_1, DAY_2, DAY_3 = datetime(2024, 1, 1), datetime(2024, 1, 2), datetime(2024, 1, 3)
REPORT = ["schema_name", "table_name", "kind", "change", "row_count", "status"]


def _only(tables: TableSource, names: list[str]) -> DataFrame:
    return selection.select_tables(tables.tables(), only=names)


def _counts_sql(names: list[str], columns: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{SCHEMAS[n]}' AS schema_name, '{n}' AS table_name, {columns},"
        f" count(*) AS row_count FROM {n}"
        for n in names
    )


def snapshot_full(spark: SparkSession, folder: str) -> DataFrame:
    root = scratch_folder(spark, "full")
    take_full(source(spark, folder), root, "full", DAY_1)
    return read_manifest(spark, root).select(
        "schema_name", "table_name", "snapshot_id", "kind", "format", "status", "row_count"
    )


def snapshot_parallel(spark: SparkSession, folder: str, parallelism: int = 4) -> DataFrame:
    root = scratch_folder(spark, "parallel")
    options = SnapshotOptions(parallelism=parallelism)
    report = snapshot_schemas(
        source(spark, folder), root, "sales,corpus", "parallel", DAY_1, options
    )
    return report.select(*REPORT)


def _restore(name: str, format: str, compression: str | None = None):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        root = scratch_folder(spark, f"{format}-{name}")
        tables = source(spark, folder)
        options = SnapshotOptions(format=format, compression=compression, parallelism=1)
        take_full(tables, root, "one", DAY_1, _only(tables, [name]), options)
        return restore.restored_tables(spark, root).read(SCHEMAS[name], name)

    return query


def later_tables(spark: SparkSession, folder: str) -> FrameTables:
    """The tables a day on: line items changed, nation gone, a table of totals new."""
    tables = source(spark, folder)
    frames = {(SCHEMAS[n], n): tables.read(SCHEMAS[n], n) for n in TABLES if n != "nation"}
    frames["sales", "lineitem"] = new_lineitem(spark, folder)
    frames["sales", "segment"] = (
        table(spark, folder, "customer")
        .groupBy("c_mktsegment")
        .agg(F.count(F.lit(1)).alias("customers"))
    )
    return FrameTables(spark, frames)


def changed_tables(spark: SparkSession, folder: str) -> DataFrame:
    root = scratch_folder(spark, "changed")
    take_full(source(spark, folder), root, "base", DAY_1)
    base = copies_as_of(read_manifest(spark, root))
    return change.changed_tables(table_measures(later_tables(spark, folder)), base)


_CHANGED_SQL = "\nUNION ALL ".join(
    [
        f"SELECT '{SCHEMAS[n]}' AS schema_name, '{n}' AS table_name, 'unchanged' AS change,"
        f" count(*) AS old_rows, count(*) AS new_rows FROM {n}"
        for n in TABLES
        if n not in ("lineitem", "nation")
    ]
    + [
        f"SELECT 'sales', 'lineitem', 'changed', (SELECT count(*) FROM lineitem), count(*)"
        f" FROM ({NEW_LINEITEM_SQL})",
        "SELECT 'shared', 'nation', 'dropped', count(*), NULL FROM nation",
        "SELECT 'sales', 'segment', 'new', NULL, count(DISTINCT c_mktsegment) FROM customer",
    ]
)


def snapshot_incremental(spark: SparkSession, folder: str) -> DataFrame:
    root = scratch_folder(spark, "incremental")
    take_full(source(spark, folder), root, "base", DAY_1)
    report = take_incremental(later_tables(spark, folder), root, "next", DAY_2)
    return report.select(*REPORT)


_INCREMENTAL_SQL = "\nUNION ALL ".join(
    [
        f"SELECT '{SCHEMAS[n]}' AS schema_name, '{n}' AS table_name, 'incremental' AS kind,"
        f" 'unchanged' AS change, count(*) AS row_count, 'unchanged' AS status FROM {n}"
        for n in TABLES
        if n not in ("lineitem", "nation")
    ]
    + [
        f"SELECT 'sales', 'lineitem', 'incremental', 'changed', count(*), 'ok'"
        f" FROM ({NEW_LINEITEM_SQL})",
        "SELECT 'shared', 'nation', 'incremental', 'dropped', NULL, 'dropped'",
        "SELECT 'sales', 'segment', 'full', 'new', count(DISTINCT c_mktsegment), 'ok'"
        " FROM customer",
    ]
)


def snapshot_by_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """An incremental snapshot of the event types which statistics call changed."""
    events = table(spark, folder, "events")
    types = sorted(r[0] for r in events.select("event_type").distinct().collect())
    frames = {("events", t): events.where(F.col("event_type") == t) for t in types}
    tables = FrameTables(spark, frames)
    root = scratch_folder(spark, "statistics")
    take_full(tables, root, "base", DAY_1)
    stats = (
        events.groupBy(F.lit("events").alias("schema_name"), F.col("event_type").alias("table_name"))
        .agg(
            F.max(F.when(F.col("value") > 340, F.col("ts"))).alias("last_analyze"),
            F.max(F.when(F.col("value") > 345, F.col("ts"))).alias("last_autoanalyze"),
        )
    )
    changed = change.changed_since(stats, "2024-01-20 00:00:00")
    return take_incremental(tables, root, "next", DAY_2, changed=changed).select(*REPORT)


_STATISTICS_SQL = """
SELECT 'events' AS schema_name, event_type AS table_name, 'incremental' AS kind,
       'changed' AS change, count(*) AS row_count, 'ok' AS status
FROM events GROUP BY event_type
HAVING max(ts) FILTER (WHERE value > 340) > TIMESTAMP '2024-01-20'
    OR max(ts) FILTER (WHERE value > 345) > TIMESTAMP '2024-01-20'
"""


def validate_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """A full snapshot, checked copy by copy; the manifest gives the counts."""
    root = scratch_folder(spark, "validate")
    take_full(source(spark, folder), root, "full", DAY_1)
    checked = restore.validate_snapshot(spark, root, "full")
    counts = read_manifest(spark, root).select("schema_name", "table_name", "row_count")
    return checked.join(counts, ["schema_name", "table_name"]).select(
        "schema_name",
        "table_name",
        "has_schema",
        "has_data",
        "row_count_ok",
        "fingerprint_ok",
        "valid",
        "row_count",
    )


def _two_days(spark: SparkSession, folder: str, label: str) -> str:
    """All tables on one day, and what changed of them on the next."""
    root = scratch_folder(spark, label)
    take_full(source(spark, folder), root, "day1", DAY_1)
    take_incremental(later_tables(spark, folder), root, "day2", DAY_2)
    return root


def _contents(tables: FrameTables) -> DataFrame:
    """What the tables of a source hold."""
    return portable_fingerprints({name: df for (_, name), df in tables.frames.items()})


_SEGMENT_SQL = sum_sql(
    "(SELECT c_mktsegment, count(*) AS customers FROM customer GROUP BY c_mktsegment)",
    [marked_sql("c_mktsegment"), marked_sql("CAST(customers AS VARCHAR)")],
    "'segment' AS table_name, ",
)


def _contents_sql(old: bool, new: bool, left: bool = False) -> str:
    """SQL for the contents of a set: the first day's tables, the second's, or both; ``left`` are
    tables of the second day that a restore of the first leaves alone."""
    parts = []
    for name in TABLES:
        rows = [f"SELECT * FROM {name}"] * old
        if new and name == "lineitem":
            rows.append(NEW_LINEITEM_SQL)
        elif new and name != "nation":
            rows.append(f"SELECT * FROM {name}")
        if rows:
            parts.append(portable_sql(name, " UNION ALL ".join(rows)))
    if new or left:
        parts.append(_SEGMENT_SQL)
    return "\nUNION ALL ".join(parts)


def restore_as_of_before(spark: SparkSession, folder: str) -> DataFrame:
    root = _two_days(spark, folder, "before")
    return _contents(restore.restored_tables(spark, root, as_of=DAY_1))


def restore_as_of_after(spark: SparkSession, folder: str) -> DataFrame:
    root = _two_days(spark, folder, "after")
    return _contents(restore.restored_tables(spark, root, as_of=DAY_3))


def restore_as_of_tables(spark: SparkSession, folder: str) -> DataFrame:
    """What a restore after the second day reads, table by table."""
    root = _two_days(spark, folder, "tables")
    return restore.chosen_copies(spark, root, as_of=DAY_3).select(
        "schema_name", "table_name", "snapshot_id", "kind", "row_count"
    )


_TABLES_SQL = "\nUNION ALL ".join(
    [
        f"SELECT '{SCHEMAS[n]}' AS schema_name, '{n}' AS table_name, 'day1' AS snapshot_id,"
        f" 'full' AS kind, count(*) AS row_count FROM {n}"
        for n in TABLES
        if n not in ("lineitem", "nation")
    ]
    + [
        f"SELECT 'sales', 'lineitem', 'day2', 'incremental', count(*) FROM ({NEW_LINEITEM_SQL})",
        "SELECT 'sales', 'segment', 'day2', 'full', count(DISTINCT c_mktsegment) FROM customer",
    ]
)


def _folder_tables(spark: SparkSession, target: str) -> FrameTables:
    """The tables that restores have put into a folder."""
    frames = {}
    for schema in files.children(spark, target):
        found = ParquetTables(spark, f"{target}/{schema}", schema)
        frames |= {(schema, name): found.read(schema, name) for name in found.names()}
    return FrameTables(spark, frames)


def _guarded(spark: SparkSession, folder: str, mode: str) -> DataFrame:
    """The second day is restored, then the first one onto it."""
    root = _two_days(spark, folder, f"guarded-{mode}")
    target = f"{root}/restored"
    restore.restore_to_folder(spark, restore.chosen_copies(spark, root), target)
    first = restore.chosen_copies(spark, root, snapshot_id="day1")
    try:
        restore.restore_to_folder(spark, first, target, mode)
    except restore.TargetExistsError:
        if mode != "error":
            raise
    return _contents(_folder_tables(spark, target))


def restore_guarded_error(spark: SparkSession, folder: str) -> DataFrame:
    return _guarded(spark, folder, "error")


def restore_guarded_force(spark: SparkSession, folder: str) -> DataFrame:
    return _guarded(spark, folder, "force")


def restore_guarded_append(spark: SparkSession, folder: str) -> DataFrame:
    return _guarded(spark, folder, "append")


def catalog_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Tables put into a database of the session's catalog, listed and measured there."""
    database = f"tablekeep_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{scratch_folder(spark, database)}'")
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        spark.catalog.createTable(f"{database}.{name}", path=path, source="parquet")
    tables = CatalogTables(spark, [database])
    return table_measures(tables).select("table_name", "row_count")


def _catalog(spark: SparkSession, folder: str, mode: str) -> DataFrame:
    """As :func:`_guarded`, with the catalog as the target."""
    root = _two_days(spark, folder, f"catalog-{mode}")
    database = f"tablekeep_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{root}/{database}'")
    place = f"{root}/catalog"
    restore.restore_to_catalog(spark, restore.chosen_copies(spark, root), place, database=database)
    first = restore.chosen_copies(spark, root, snapshot_id="day1")
    restore.restore_to_catalog(spark, first, place, mode, database)
    found = CatalogTables(spark, [database])
    return _contents(FrameTables(spark, {(s, n): found.read(s, n) for s, n in found.tables().collect()}))


def restore_catalog_force(spark: SparkSession, folder: str) -> DataFrame:
    return _catalog(spark, folder, "force")


def restore_catalog_append(spark: SparkSession, folder: str) -> DataFrame:
    return _catalog(spark, folder, "append")


def snapshot_list(spark: SparkSession, folder: str) -> DataFrame:
    """The snapshots of two days, without their sizes and times."""
    root = _two_days(spark, folder, "list")
    known = snapshots(read_manifest(spark, root))
    return known.select("name", "kind", "tables", "row_count")


_LIST_SQL = f"""
SELECT 'day1' AS name, 'full' AS kind, CAST({len(TABLES)} AS BIGINT) AS tables,
       {" + ".join(f"(SELECT count(*) FROM {n})" for n in TABLES)} AS row_count
UNION ALL
SELECT 'day2', 'incremental', 2,
       (SELECT count(*) FROM ({NEW_LINEITEM_SQL}))
         + (SELECT count(DISTINCT c_mktsegment) FROM customer)
"""


def restore_by_name(spark: SparkSession, folder: str) -> DataFrame:
    """The first day found by a part of its name, restored from the root of two days."""
    root = _two_days(spark, folder, "by-name")
    restore_snapshot(spark, root, f"{root}/restored", name="y1")
    return _contents(_folder_tables(spark, f"{root}/restored"))


_CHANGES = 5  # days on which rows go and rows are doubled, by the first hexadecimal digit of a hash


def _digit(name: str):
    key = KEYS[name][0]
    return F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 1), 16, 10).cast("int")


def _on_day(spark: SparkSession, folder: str, day: int) -> FrameTables:
    """All tables some days on: each day a sixteenth of the rows goes and another comes twice."""
    times = [0 if 1 <= digit <= day else 2 if 6 <= digit <= 5 + day else 1 for digit in range(16)]
    copies = F.array(*[F.array_repeat(F.lit(1), n) for n in times])
    frames = {}
    for key, df in _present(spark, folder).frames.items():
        own = free_name(df.columns, "copy")
        frames[key] = df.select("*", F.explode(F.get(copies, _digit(key[1]))).alias(own)).drop(own)
    return FrameTables(spark, frames)


def _delta_chain(spark: SparkSession, folder: str) -> str:
    root, options = scratch_folder(spark, "chain"), SnapshotOptions(deltas=True)
    take_full(_on_day(spark, folder, 0), root, "day0", DAY_1)
    for day in range(1, _CHANGES + 1):
        at = DAY_1 + timedelta(days=day)
        take_incremental(_on_day(spark, folder, day), root, f"day{day}", at, options=options)
    return root


def delta_chain(spark: SparkSession, folder: str) -> DataFrame:
    """All tables after five deltas, and as of the third, from one whole copy and the changes."""
    root = _delta_chain(spark, folder)
    found = []
    for day in (3, _CHANGES):
        tables = restore.restored_tables(spark, root, as_of=DAY_1 + timedelta(days=day))
        found.append(_contents(tables).withColumn("day", F.lit(day)))
    return union_all(found)


def _on_day_sql(name: str, day: int) -> str:
    digit = f"CAST('0x' || substr(md5(CAST({KEYS[name][0]} AS VARCHAR)), 1, 1) AS INTEGER)"
    return (
        f"SELECT * FROM {name} WHERE {digit} NOT BETWEEN 1 AND {day}"
        f" UNION ALL SELECT * FROM {name} WHERE {digit} BETWEEN 6 AND {5 + day}"
    )


def _chain_sql() -> str:
    return "\nUNION ALL ".join(
        f"SELECT *, {day} AS day FROM ({portable_sql(n, _on_day_sql(n, day))})"
        for day in (3, _CHANGES)
        for n in TABLES
    )


KEYS = {
    "benchmark": ["item_id"], "conversations": ["conv_id"], "customer": ["c_custkey"],
    "documents": ["doc_id"], "embeddings": ["vec_id"], "events": ["event_id"], "labels": ["doc_id"],
    "lineitem": ["l_orderkey"], "nation": ["n_nationkey"], "orders": ["o_orderkey"],
    "pages": ["page_id"], "part": ["p_partkey"], "region": ["r_regionkey"], "supplier": ["s_suppkey"],
}


def _bucketed_days(spark: SparkSession, folder: str, later: dict) -> tuple[dict, dict]:
    """Copies with hash trees of all tables and of a later state, by table name."""
    root = scratch_folder(spark, "trees")
    options = SnapshotOptions(buckets=64, keys=KEYS)
    today = _present(spark, folder)
    take_full(today, root, "day1", DAY_1, options=options)
    take_full(FrameTables(spark, {**today.frames, **later}), root, "day2", DAY_2, options=options)
    rows = read_manifest(spark, root).collect()
    return tuple(
        {r["table_name"]: r for r in rows if r["snapshot_id"] == day} for day in ("day1", "day2")
    )


def bucket_delta(spark: SparkSession, folder: str) -> DataFrame:
    """Row deltas of line items from two copies, by the buckets that differ in their trees."""
    old, new = _bucketed_days(spark, folder, {("sales", "lineitem"): new_lineitem(spark, folder)})
    schema = schema_of(old["lineitem"]["schema_json"])
    return copy_delta(spark, old["lineitem"]["path"], new["lineitem"]["path"], schema)


def _one_order(spark: SparkSession, folder: str) -> DataFrame:
    """Line items of which the last order is taken back."""
    lines = table(spark, folder, "lineitem")
    last = lines.agg(F.max("l_orderkey").alias("last"))
    returned = F.when(F.col("l_orderkey") == F.col("last"), "X").otherwise(F.col("l_returnflag"))
    return lines.join(last).withColumn("l_returnflag", returned).drop("last")


def bucket_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Per table how many buckets differ after one order was changed, and which rows are read."""
    old, new = _bucketed_days(spark, folder, {("sales", "lineitem"): _one_order(spark, folder)})
    found = []
    for name in TABLES:
        paths = old[name]["path"], new[name]["path"]
        buckets = changed_buckets(spark, *paths)
        parts = differing_parts(spark, *paths, schema_of(old[name]["schema_json"]))
        read = sum(part.count() for part in parts)
        few = 10 * read < old[name]["row_count"] + new[name]["row_count"]
        found.append((name, buckets, old[name]["row_count"], few))
    ddl = "table_name string, buckets array<int>, row_count bigint, few_read boolean"
    return small_frame(spark, found, ddl)


_TREE_SQL = "\nUNION ALL ".join(
    f"SELECT '{n}' AS table_name, CAST({'[]' if n != 'lineitem' else _bucket} AS INTEGER[]) AS buckets,"
    f" count(*) AS row_count, count(*) > 0 AS few_read FROM {n}"
    for n in TABLES
    for _bucket in [
        "[CAST(CAST('0x' || substr(md5(length(CAST(max(l_orderkey) AS VARCHAR)) || ':'"
        " || CAST(max(l_orderkey) AS VARCHAR)), 1, 8) AS UINTEGER) AS BIGINT) % 64]"
    ]
)


def backup_run(spark: SparkSession, folder: str) -> DataFrame:
    """Two verified runs; the first is out of retention once the second is done."""
    root, tables = scratch_folder(spark, "run"), source(spark, folder)
    back_up(tables, root, "january", datetime(2024, 1, 1))
    back_up(tables, root, "march", datetime(2024, 3, 1), retention_days=30)
    return read_manifest(spark, root).select(
        "schema_name", "table_name", "snapshot_id", "status", "row_count"
    )


def _failing(tables: FrameTables, names: list[str]) -> FrameTables:
    """The same tables, of which some cannot be read."""
    frames = dict(tables.frames)
    for name in names:
        key = (SCHEMAS[name], name)
        frames[key] = frames[key].where(F.raise_error(F.lit("unreadable")).isNull())
    return FrameTables(tables.spark, frames)


def _present(spark: SparkSession, folder: str) -> FrameTables:
    tables = source(spark, folder)
    return FrameTables(spark, {(SCHEMAS[n], n): tables.read(SCHEMAS[n], n) for n in TABLES})


def _as_restored(spark: SparkSession, root: str) -> DataFrame:
    """What a restore reads now, every table counted and checked."""
    checked = restore.validate_snapshot(spark, root)
    counts = restore.chosen_copies(spark, root).select("schema_name", "table_name", "row_count")
    return checked.join(counts, ["schema_name", "table_name"]).select(
        "schema_name", "table_name", "snapshot_id", "valid", "row_count"
    )


def snapshot_rerun_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """An incremental run that fails at a table is run again; nothing it wrote is lost."""
    root, later = scratch_folder(spark, "rerun"), later_tables(spark, folder)
    take_full(source(spark, folder), root, "base", DAY_1)
    frames = dict(later.frames)
    dearer = F.col("o_totalprice") + 1
    frames["sales", "orders"] = frames["sales", "orders"].withColumn("o_totalprice", dearer)
    later = FrameTables(spark, frames)
    record = SnapshotOptions(on_error="record")
    take_incremental(_failing(later, ["orders"]), root, "next", DAY_2, options=record)
    take_incremental(later, root, "next", DAY_2)
    return _as_restored(spark, root)


_RERUN_SQL = "\nUNION ALL ".join(
    [
        f"SELECT '{SCHEMAS[n]}' AS schema_name, '{n}' AS table_name, 'base' AS snapshot_id,"
        f" TRUE AS valid, count(*) AS row_count FROM {n}"
        for n in TABLES
        if n not in ("lineitem", "nation", "orders")
    ]
    + [
        f"SELECT 'sales', 'lineitem', 'next', TRUE, count(*) FROM ({NEW_LINEITEM_SQL})",
        "SELECT 'sales', 'orders', 'next', TRUE, count(*) FROM orders",
        "SELECT 'sales', 'segment', 'next', TRUE, count(DISTINCT c_mktsegment) FROM customer",
    ]
)


def snapshot_rerun_failed(spark: SparkSession, folder: str) -> DataFrame:
    """A full run is run again and fails at three tables; rotation then takes no good copy."""
    root, tables = scratch_folder(spark, "rerun-failed"), _present(spark, folder)
    take_full(tables, root, "full", DAY_1)
    record = SnapshotOptions(on_error="record")
    take_full(_failing(tables, ["pages", "part", "labels"]), root, "full", DAY_2, options=record)
    apply_retention(spark, root, datetime(2024, 6, 1), 30)
    return _as_restored(spark, root)


def snapshot_two_schemas_one_id(spark: SparkSession, folder: str) -> DataFrame:
    """One id for three runs, each of one schema."""
    root = scratch_folder(spark, "schemas")
    for schema in sorted(set(SCHEMAS.values())):
        snapshot_schemas(source(spark, folder), root, schema, "full", DAY_1)
    return _as_restored(spark, root)


_AS_RESTORED_SQL = _counts_sql(TABLES, "'full' AS snapshot_id, TRUE AS valid")


def _restored_set(mode: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        """All tables restored into a folder, and then once more onto themselves."""
        root = scratch_folder(spark, f"set-{mode}")
        take_full(source(spark, folder), root, "full", DAY_1)
        copies = restore.chosen_copies(spark, root)
        restore.restore_to_folder(spark, copies, f"{root}/restored")
        restore.restore_to_folder(spark, copies, f"{root}/restored", mode)
        back = FrameTables(
            spark,
            {
                (SCHEMAS[n], n): spark.read.parquet(f"{root}/restored/{SCHEMAS[n]}/{n}.parquet")
                for n in TABLES
            },
        )
        return table_measures(back).select("schema_name", "table_name", "row_count")

    return query


def _set_sql(times: int) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{SCHEMAS[n]}' AS schema_name, '{n}' AS table_name,"
        f" {times} * count(*) AS row_count FROM {n}"
        for n in TABLES
    )


def sketch_estimates(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct values and medians of all events, from the sketches kept with a copy per event type."""
    root, events = scratch_folder(spark, "sketches"), table(spark, folder, "events")
    types = sorted(r[0] for r in events.select("event_type").distinct().collect())
    frames = {("events", t): events.where(F.col("event_type") == t) for t in types}
    take_full(FrameTables(spark, frames), root, "all", DAY_1, options=SnapshotOptions(sketches=True))
    kept = merged(copy_sketches(spark, read_manifest(spark, root)))
    found = estimates(kept, [0.49, 0.51]).alias("found")
    exact = table_profiles({"events": events}, distinct="exact").alias("exact")
    median = events.agg(F.percentile("value", 0.5).alias("median"))
    off = F.abs(F.col("found.distinct_count") - F.col("exact.distinct_count"))
    inside = F.col("median").between(F.col("quantiles")[0], F.col("quantiles")[1])
    return (
        found.join(exact, F.col("found.column_name") == F.col("exact.column_name"))
        .join(median)
        .select(
            "found.column_name",
            "found.row_count",
            "found.non_null",
            (off <= 0.03 * F.col("exact.distinct_count")).alias("distinct_close"),
            F.when(F.col("found.column_name") == "value", inside).alias("median_inside"),
        )
    )


_SKETCH_SQL = "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS row_count, count({c}) AS non_null,"
    f" TRUE AS distinct_close, {'TRUE' if c == 'value' else 'CAST(NULL AS BOOLEAN)'} AS median_inside"
    " FROM events"
    for c, _ in columns("events")
)


def restore_points_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """What the catalogue offers for a restore is what a restore reads: no table that is gone."""
    root = scratch_folder(spark, "points")
    take_full(source(spark, folder), root, "base", DAY_1)
    take_incremental(later_tables(spark, folder), root, "next", DAY_2)
    known = from_manifest(read_manifest(spark, root))
    return restore_points(known, DAY_3, "run_id").select("name", "table_name", "kind")


_POINTS_SQL = "\nUNION ALL ".join(
    [
        f"SELECT '{SCHEMAS[n]}.{n}@base' AS name, '{SCHEMAS[n]}.{n}' AS table_name, 'full' AS kind"
        f" FROM {n} HAVING count(*) >= 0"
        for n in TABLES
        if n not in ("lineitem", "nation")
    ]
    + [
        "SELECT 'sales.lineitem@next', 'sales.lineitem', 'incremental'",
        "SELECT 'sales.segment@next', 'sales.segment', 'full'",
    ]
)


def changed_tables_renamed(spark: SparkSession, folder: str) -> DataFrame:
    """Every table against itself with its first column renamed: the same hashes, another schema."""
    now = _present(spark, folder)
    renamed = {
        key: df.withColumnRenamed(df.columns[0], "renamed") if key[1] != "nation" else df
        for key, df in now.frames.items()
    }
    found = change.changed_tables(table_measures(FrameTables(spark, renamed)), table_measures(now))
    return found.select("schema_name", "table_name", "change", "new_rows")


_RENAMED_SQL = "\nUNION ALL ".join(
    f"SELECT '{SCHEMAS[n]}' AS schema_name, '{n}' AS table_name,"
    f" '{'unchanged' if n == 'nation' else 'changed'}' AS change, count(*) AS new_rows FROM {n}"
    for n in TABLES
)


_MONTHS = {
    "january": (datetime(2024, 1, 1), TABLES),
    "february": (datetime(2024, 2, 1), [n for n in TABLES if SCHEMAS[n] != "shared"]),
    "march": (datetime(2024, 3, 1), [n for n in TABLES if SCHEMAS[n] == "sales"]),
}


def retention_apply(spark: SparkSession, folder: str) -> DataFrame:
    """Full snapshots of all tables, of two schemas and of one; what is left after rotation."""
    root = scratch_folder(spark, "rotation")
    tables = source(spark, folder)
    for snapshot_id, (at, names) in _MONTHS.items():
        take_full(tables, root, snapshot_id, at, _only(tables, names))
    apply_retention(spark, root, datetime(2024, 3, 15), 30)
    left = from_manifest(read_manifest(spark, root)).select("name")
    counts = union_all(
        spark.read.parquet(r["path"]).agg(
            F.lit(f"{r['schema_name']}.{r['table_name']}@{r['snapshot_id']}").alias("name"),
            F.count(F.lit(1)).alias("row_count"),
        )
        for r in read_manifest(spark, root).collect()
    )
    return left.join(counts, "name")


_APPLY_SQL = "\nUNION ALL ".join(
    f"SELECT '{SCHEMAS[n]}.{n}@{[m for m, (_, names) in _MONTHS.items() if n in names][-1]}' AS name,"
    f" count(*) AS row_count FROM {n}"
    for n in TABLES
)


def snapshot_incremental_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """An incremental snapshot of a database of the catalog in which one table's files changed."""
    root = scratch_folder(spark, "catalog-incremental")
    database = f"tablekeep_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{root}/{database}'")
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if name == "lineitem":
            path = f"{root}/own/lineitem"
            table(spark, folder, name).write.parquet(path)
        spark.catalog.createTable(f"{database}.{name}", path=path, source="parquet")
    tables = CatalogTables(spark, [database])
    take_full(tables, f"{root}/copies", "base", DAY_1)
    new_lineitem(spark, folder).write.mode("overwrite").parquet(f"{root}/own/lineitem")
    spark.catalog.refreshTable(f"{database}.lineitem")
    report = take_incremental(tables, f"{root}/copies", "next", DAY_2)
    return report.select("table_name", "kind", "change", "row_count", "status")


_CATALOG_SQL = "\nUNION ALL ".join(
    f"SELECT '{n}' AS table_name, 'incremental' AS kind,"
    f" '{'changed' if n == 'lineitem' else 'unchanged'}' AS change, count(*) AS row_count,"
    f" '{'ok' if n == 'lineitem' else 'unchanged'}' AS status"
    f" FROM {f'({NEW_LINEITEM_SQL})' if n == 'lineitem' else n}"
    for n in TABLES
)


def _streamed(spark: SparkSession, folder: str, runs: int) -> str:
    """Events dealt out to files and taken over in batches of some files."""
    root = scratch_folder(spark, "stream")
    events = table(spark, folder, "events")
    events.repartition(10, "event_id").write.parquet(f"{root}/arrived")
    for _ in range(runs):
        stream = new_files(spark, f"{root}/arrived", events.schema, max_files_per_batch=4)
        append_batches(stream, root, "sales", "events", f"{root}/checkpoint")
    return root


def incremental_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events taken over as a stream of files; the second run finds nothing new."""
    return appended_table(spark, _streamed(spark, folder, 2), "sales", "events")


def incremental_stream_replayed(spark: SparkSession, folder: str) -> DataFrame:
    """What the manifest says of a stream whose last batch is run again: each row counts once."""
    root = _streamed(spark, folder, 1)
    files.delete(spark, f"{root}/checkpoint/commits/2")
    stream = new_files(spark, f"{root}/arrived", table(spark, folder, "events").schema, max_files_per_batch=4)
    again = append_batches(stream, root, "sales", "events", f"{root}/checkpoint")
    return appended_rows(spark, root).withColumn("rows_of_replay", F.lit(again).cast("bigint"))


_FULL_SQL = _counts_sql(
    TABLES, "'full' AS snapshot_id, 'full' AS kind, 'parquet' AS format, 'ok' AS status"
)
_PARALLEL_SQL = _counts_sql(
    [n for n in TABLES if SCHEMAS[n] != "shared"],
    "'full' AS kind, 'full' AS change, 'ok' AS status",
)
_VALIDATE_SQL = _counts_sql(
    TABLES,
    "TRUE AS has_schema, TRUE AS has_data, TRUE AS row_count_ok, TRUE AS fingerprint_ok,"
    " TRUE AS valid",
)

QUERIES = {
    "snapshot_full": (snapshot_full, _FULL_SQL),
    "snapshot_parallel": (snapshot_parallel, _PARALLEL_SQL),
    **{f"snapshot_restore_{n}": (_restore(n, "parquet"), f"SELECT * FROM {n}") for n in TABLES},
    **{f"snapshot_text_restore_{n}": (_restore(n, "json"), f"SELECT * FROM {n}") for n in TABLES},
    "changed_tables": (changed_tables, _CHANGED_SQL),
    "snapshot_incremental": (snapshot_incremental, _INCREMENTAL_SQL),
    "snapshot_by_statistics": (snapshot_by_statistics, _STATISTICS_SQL),
    "validate_snapshot": (validate_snapshot, _VALIDATE_SQL),
    "restore_as_of_before": (restore_as_of_before, _contents_sql(True, False)),
    "restore_as_of_after": (restore_as_of_after, _contents_sql(False, True)),
    "restore_as_of_tables": (restore_as_of_tables, _TABLES_SQL),
    "restore_guarded_error": (restore_guarded_error, _contents_sql(False, True)),
    "restore_guarded_force": (restore_guarded_force, _contents_sql(True, False, left=True)),
    "restore_guarded_append": (
        restore_guarded_append,
        _contents_sql(True, True),
    ),
    "snapshot_plain_text_restore_documents": (
        _restore("documents", "json", "none"),
        "SELECT * FROM documents",
    ),
    "catalog_tables": (
        catalog_tables,
        "\nUNION ALL ".join(
            f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}"
            for n in TABLES
        ),
    ),
    "restore_catalog_force": (restore_catalog_force, _contents_sql(True, False, left=True)),
    "restore_catalog_append": (
        restore_catalog_append,
        _contents_sql(True, True),
    ),
    "snapshot_list": (snapshot_list, _LIST_SQL),
    "restore_by_name": (restore_by_name, _contents_sql(True, False)),
    "bucket_delta": (bucket_delta, delta_sql("SELECT * FROM lineitem", NEW_LINEITEM_SQL)),
    "bucket_tree": (bucket_tree, _TREE_SQL),
    "sketch_estimates": (sketch_estimates, _SKETCH_SQL),
    "delta_chain": (delta_chain, _chain_sql()),
    "backup_run": (
        backup_run,
        _counts_sql(TABLES, "'march' AS snapshot_id, 'ok' AS status"),
    ),
    "retention_apply": (retention_apply, _APPLY_SQL),
    "snapshot_incremental_catalog": (snapshot_incremental_catalog, _CATALOG_SQL),
    "snapshot_rerun_incremental": (snapshot_rerun_incremental, _RERUN_SQL),
    "snapshot_rerun_failed": (snapshot_rerun_failed, _AS_RESTORED_SQL),
    "snapshot_two_schemas_one_id": (snapshot_two_schemas_one_id, _AS_RESTORED_SQL),
    "restore_set_force": (_restored_set("force"), _set_sql(1)),
    "restore_set_append": (_restored_set("append"), _set_sql(2)),
    "restore_points_manifest": (restore_points_manifest, _POINTS_SQL),
    "changed_tables_renamed": (changed_tables_renamed, _RENAMED_SQL),
    "incremental_stream": (incremental_stream, "SELECT * FROM events"),
    "incremental_stream_replayed": (
        incremental_stream_replayed,
        "SELECT 'sales' AS schema_name, 'events' AS table_name, CAST(3 AS BIGINT) AS batches,"
        " count(*) AS row_count, CAST(0 AS BIGINT) AS rows_of_replay FROM events",
    ),
}
