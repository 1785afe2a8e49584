"""Applying a retention plan."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from itertools import islice

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablekeep.functions.times import DEFAULT_RETENTION_DAYS, expired
from tablekeep.operators.catalogue import from_manifest, present
from tablekeep.operators.retention import retention, retention_plan
from tablekeep.plans.jobs import run_jobs
from tablekeep.plans.manifest import (
    append_removed,
    built_upon,
    orphan_folders,
    pending_removals,
    read_manifest,
    unusable_copies,
)
from tablekeep.plans.snapshot import DEFAULT_PARALLELISM
from tablekeep.sources import files
from tablekeep.session import scratch_folder
from tablekeep.sources.artifacts import list_files
from tablekeep.sources.listing import deleted


BATCH = 1000  # paths that are on the driver at a time while they are deleted


def _delete(spark: SparkSession, paths: list[str], parallelism: int) -> None:
    for _, _, error in run_jobs(spark, lambda p: files.delete(spark, p), paths, parallelism):
        if error is not None:
            raise error


def _batches(paths: DataFrame) -> Iterator[list[str]]:
    rows = paths.toLocalIterator()
    while batch := [r[0] for r in islice(rows, BATCH)]:
        yield batch


def delete_planned(spark: SparkSession, plan: DataFrame) -> DataFrame:
    """Delete the files a plan names removable, and nothing else; returns their paths.

    Files are deleted by the tasks that list them, and what they deleted is a table in the shared
    folder, so no path goes through the driver.
    """
    done = scratch_folder(spark, "rotated")
    deleted(plan.where("removable")).write.parquet(done)
    return spark.read.schema("path string, deleted boolean").parquet(done).select("path").distinct()


def rotate_files(
    spark: SparkSession,
    prefix: str,
    as_of: datetime,
    pattern: str = "backup_*",
    days: int = DEFAULT_RETENTION_DAYS,
    rule: str = "whole_days",
    recursive: bool = False,
) -> DataFrame:
    """Delete files below a prefix which are out of retention by their own time.

    Dump files know of no base and no table, so age alone decides. Returns the paths.
    """
    aged = retention(list_files(spark, prefix, pattern, recursive), as_of, days, rule)
    return delete_planned(spark, aged.withColumnRenamed("expired", "removable"))


def retention_apply(
    spark: SparkSession,
    root: str,
    as_of: datetime,
    days: int = DEFAULT_RETENTION_DAYS,
    rule: str = "exact",
    parallelism: int = DEFAULT_PARALLELISM,
) -> DataFrame:
    """Remove the copies of a snapshot root which are out of retention.

    They leave the catalogue first and the storage second, so a run that dies in
    between never leaves an entry without data; what it left undeleted is deleted
    next time. What replaced, failed and dead runs left behind goes with its age.
    No table loses the copy a restore reads now, and no kept copy what it is built on.
    Returns the paths.
    """
    root = root.rstrip("/")
    manifest = read_manifest(spark, root)
    plan = retention_plan(present(from_manifest(manifest)), as_of, days, rule, tie_break="run_id")
    kept = plan.where("NOT removable").select("path")
    needed = built_upon(manifest.join(kept, "path", "left_semi"))
    old = expired(F.col("created_at"), as_of, days, rule)
    left_behind = unusable_copies(spark, root).select("path", "created_at")
    left_behind = left_behind.unionByName(orphan_folders(spark, root)).where(old)
    removable = plan.where("removable").select("path").unionAll(left_behind.select("path"))
    chosen = scratch_folder(spark, "removable")
    removable.distinct().join(needed, "path", "left_anti").write.parquet(chosen)
    gone = spark.read.schema("path string").parquet(chosen)
    for batch in _batches(gone):
        rows = [{"path": p, "removed_at": as_of, "deleted": False} for p in batch]
        append_removed(spark, root, rows)
    for batch in _batches(pending_removals(spark, root)):
        _delete(spark, batch, parallelism)
        rows = [{"path": p, "removed_at": as_of, "deleted": True} for p in batch]
        append_removed(spark, root, rows)
    return gone
