"""The manifest: one row per table and run, appended and never rewritten.

Layout below a root folder::

    manifest/   a log with a commit per row, written as soon as a table's data is
    removed/    a log of the paths retention has let go, written before they are
                deleted, and again when they are gone
    tables/<schema>/<table>/<snapshot_id>-<run_id>/   the data of one copy, or what
                changed since others: its row's ``chain`` names these, the whole
                copy first

A copy counts only once its row is in ``manifest``, so a table that a dead run was
at leaves no trace in the catalogue, and the tables it was done with are not lost.
A run without errors ends with a row of its own, status ``closed``. Running a
snapshot id again replaces copies table by table: only a later good copy, or the
finding that the table is gone, takes the place of an earlier one.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablekeep.functions.times import moment
from tablekeep.plans.commit_log import CommitLog
from tablekeep.sources import files
from tablekeep.sources.small import small_frame

MANIFEST = (
    "snapshot_id string, run_id string, kind string, schema_name string, table_name string,"
    " path string, format string, row_count bigint, fingerprint decimal(38,0),"
    " schema_json string, size_bytes bigint, source_state string, created_at timestamp_ntz,"
    " status string, error string, run_kind string, chain array<string>"
)
REMOVED = "path string, removed_at timestamp_ntz, deleted boolean"

COLUMNS = [part.split()[0] for part in MANIFEST.split(", ")]


def new_run_id() -> str:
    """Sorts by start time; unique also among runs started together."""
    now = datetime.now(timezone.utc)
    return f"{now:%Y%m%d%H%M%S%f}-{uuid.uuid4().hex[:8]}"


def copy_folder(
    root: str, schema_name: str, table_name: str, snapshot_id: str, run_id: str
) -> str:
    """Folder of one copy; characters that mean something in a path are escaped."""
    parts = [schema_name, table_name, f"{snapshot_id}-{run_id}"]
    return f"{root}/tables/" + "/".join(quote(part, safe="") for part in parts)


def manifest_log(spark: SparkSession, root: str) -> CommitLog:
    return CommitLog(spark, f"{root}/manifest", MANIFEST)


def removed_log(spark: SparkSession, root: str) -> CommitLog:
    return CommitLog(spark, f"{root}/removed", REMOVED)


def append_manifest(spark: SparkSession, root: str, rows: list[dict]) -> None:
    manifest_log(spark, root).append(rows)


def append_removed(spark: SparkSession, root: str, rows: list[dict]) -> None:
    removed_log(spark, root).append(rows)


def read_log(spark: SparkSession, root: str) -> DataFrame:
    """Every row ever written."""
    return manifest_log(spark, root).read()


def _removed(spark: SparkSession, root: str) -> DataFrame:
    return removed_log(spark, root).read()


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Rows in force: per snapshot id and table the last that is good or says that the table is
    gone, else the last failure; without what retention has removed."""
    log = read_log(spark, root).where("status <> 'closed'")
    settled = F.col("status") != "failed"
    newest = F.max_by(F.struct(*COLUMNS), F.struct(settled, "run_id"))
    rows = log.groupBy("snapshot_id", "schema_name", "table_name").agg(newest.alias("row"))
    removed = _removed(spark, root).select("path").distinct()
    return rows.select("row.*").join(removed, "path", "left_anti").select(*COLUMNS)


def unusable_copies(spark: SparkSession, root: str) -> DataFrame:
    """Rows of folders no restore reads: of tables that failed, and of copies that a good copy of
    the same table and snapshot id has replaced."""
    log = read_log(spark, root).where("path <> ''")
    removed = _removed(spark, root).select("path").distinct()
    usable = read_manifest(spark, root).where("status = 'ok'")
    keys = ["snapshot_id", "schema_name", "table_name"]
    left = log.join(removed, "path", "left_anti").join(usable.select("path"), "path", "left_anti")
    failed = left.where("status = 'failed'").select(*COLUMNS)
    replaced = left.where("status <> 'failed'").join(usable.select(*keys), keys, "left_semi")
    return failed.unionByName(replaced.select(*COLUMNS))


def built_upon(rows: DataFrame) -> DataFrame:
    """Paths of the copies that those of some rows are built on."""
    return rows.select(F.explode("chain").alias("path")).distinct()


def pending_removals(spark: SparkSession, root: str) -> DataFrame:
    """Paths out of the catalogue whose deletion was not seen to end."""
    removed = _removed(spark, root)
    gone = removed.where("deleted").select("path").distinct()
    return removed.select("path").distinct().join(gone, "path", "left_anti")


def orphan_folders(spark: SparkSession, root: str) -> DataFrame:
    """Folders of copies that no manifest row names, with the start of their run.

    They are what runs left that died while they wrote, or what a run is writing now.
    """
    tables, found = f"{root}/tables", []
    if files.exists(spark, tables):
        for schema in files.children(spark, tables):
            for table in files.children(spark, f"{tables}/{schema}"):
                for copy in files.children(spark, f"{tables}/{schema}/{table}"):
                    found.append((f"{tables}/{schema}/{table}/{copy}", copy[-29:-9]))
    rows = small_frame(spark, found, "path string, started string")
    started = F.try_to_timestamp(F.substring("started", 1, 14), F.lit("yyyyMMddHHmmss"))
    rows = rows.withColumn("created_at", started.cast("timestamp_ntz"))
    known = read_log(spark, root).select("path")
    return rows.join(known, "path", "left_anti").select("path", "created_at")


def copies_as_of(manifest: DataFrame, as_of: datetime | str | None = None) -> DataFrame:
    """Per table the newest row at or before a time; a dropped table has none.

    A table needs a full copy by then. What an incremental run found dropped is
    a row of its own and hides the earlier copies.
    """
    rows = manifest.where("status IN ('ok', 'dropped')")
    if as_of is not None:
        rows = rows.where(F.col("created_at") <= moment(as_of))
    newest = F.max_by(F.struct(*COLUMNS), F.struct("created_at", "run_id"))
    return (
        rows.groupBy("schema_name", "table_name")
        .agg(newest.alias("copy"), F.bool_or(F.col("kind") == "full").alias("has_base"))
        .where("has_base AND copy.status = 'ok'")
        .select("copy.*")
    )
