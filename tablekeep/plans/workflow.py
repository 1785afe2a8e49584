"""Whole runs: back up and rotate; find a snapshot and restore it."""

from __future__ import annotations

from dataclasses import replace
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession

from tablekeep.functions.times import DEFAULT_RETENTION_DAYS
from tablekeep.operators import catalogue
from tablekeep.plans.manifest import read_manifest
from tablekeep.plans.restore import chosen_copies, restore_to_folder
from tablekeep.plans.rotation import retention_apply
from tablekeep.plans.snapshot import SnapshotOptions, snapshot_full, snapshot_incremental
from tablekeep.sources.tables import TableSource


def back_up(
    source: TableSource,
    root: str,
    snapshot_id: str | None = None,
    at: datetime | None = None,
    incremental: bool = False,
    tables: DataFrame | None = None,
    changed: DataFrame | None = None,
    retention_days: int | None = DEFAULT_RETENTION_DAYS,
    rule: str = "exact",
    options: SnapshotOptions = SnapshotOptions(),
) -> DataFrame:
    """A verified snapshot, full or incremental, and then rotation.

    Rotation only follows a snapshot without errors. ``retention_days=None``
    leaves old copies alone.
    """
    at = at or datetime.now(timezone.utc).replace(tzinfo=None)
    options = replace(options, verify=True)
    if incremental:
        report = snapshot_incremental(source, root, snapshot_id, at, tables, changed, options)
    else:
        report = snapshot_full(source, root, snapshot_id, at, tables, options)
    if retention_days is not None and report.where("status = 'failed'").isEmpty():
        retention_apply(source.spark, root, at, retention_days, rule, options.parallelism)
    return report


def find_snapshot(
    spark: SparkSession, root: str, name: str | None = None, day: date | str | None = None
) -> Row:
    """The newest snapshot, the newest whose id contains a text, or the newest of a day."""
    known = catalogue.snapshots(read_manifest(spark, root.rstrip("/")))
    if name:
        return catalogue.find_by_name(known, name).first()
    if day:
        return catalogue.find_by_date(known, day).first()
    return catalogue.required(catalogue.latest_artifact(known), f"no snapshot in {root}").first()


def restore_snapshot(
    spark: SparkSession,
    root: str,
    target: str,
    name: str | None = None,
    day: date | str | None = None,
    tables: str | None = None,
    schemas: str | None = None,
    mode: str = "error",
) -> DataFrame:
    """Restore the tables as they were when the snapshot found was taken."""
    found = find_snapshot(spark, root, name, day)
    copies = chosen_copies(spark, root, found["modified_at"], None, tables, schemas)
    return restore_to_folder(spark, copies, target, mode)
