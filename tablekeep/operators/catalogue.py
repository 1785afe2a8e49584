"""The artifact catalogue: list, newest, by name, by date, chain, storage used.

An artifact is a row (name, table_name, kind, modified_at, size_bytes, path or
other columns). Newest means by ``modified_at``; ``tie_break`` orders artifacts
of the same time.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, functions as F

from tablekeep.functions.naming import backup_name_for_day, base_name, qualified
from tablekeep.functions.sizes import readable
from tablekeep.functions.times import moment
from tablekeep.operators.ranking import number_in_order, since_last


class NoArtifactError(LookupError):
    """No artifact answers the request."""


def from_manifest(manifest: DataFrame) -> DataFrame:
    """Artifacts of the tables a manifest holds, those written without error only.

    That a table was found gone is an artifact of kind ``dropped``, without a size
    or a path; the operators here take it for the end of what came before.
    ``run_id`` orders copies of the same time, as restores do.
    """
    table = qualified(F.col("schema_name"), F.col("table_name"))
    return manifest.where("status IN ('ok', 'dropped')").select(
        F.concat(table, F.lit("@"), F.col("snapshot_id")).alias("name"),
        table.alias("table_name"),
        F.when(F.col("status") == "dropped", "dropped").otherwise(F.col("kind")).alias("kind"),
        F.col("created_at").alias("modified_at"),
        "size_bytes",
        "path",
        "run_id",
    )


def present(artifacts: DataFrame) -> DataFrame:
    """Artifacts that can be read: without those that say a table is gone."""
    return artifacts.where(~F.col("kind").eqNullSafe("dropped"))


def snapshots(manifest: DataFrame) -> DataFrame:
    """The snapshots of a manifest as artifacts, one row each.

    A snapshot is ``full`` if all its copies are.
    """
    return (
        manifest.where("status = 'ok'")
        .groupBy(F.col("snapshot_id").alias("name"))
        .agg(
            F.when(F.bool_and(F.col("kind") == "full"), "full")
            .otherwise("incremental")
            .alias("kind"),
            F.max("created_at").alias("modified_at"),
            F.count(F.lit(1)).alias("tables"),
            F.sum("row_count").alias("row_count"),
            F.sum("size_bytes").alias("size_bytes"),
        )
    )


def artifact_list(artifacts: DataFrame, tie_break: str = "name", by: str = "time") -> DataFrame:
    """All artifacts with sizes for people, newest first or by name."""
    orders = {"time": [F.desc("modified_at"), F.desc(tie_break)], "name": ["name"]}
    return artifacts.withColumn("size", readable(F.col("size_bytes"))).orderBy(*orders[by])


def _newest(artifacts: DataFrame, tie_break: str, group: list[str]) -> DataFrame:
    """Newest artifact per group; each task sends one row per group."""
    row = F.max_by(F.struct(*artifacts.columns), F.struct("modified_at", tie_break))
    return artifacts.groupBy(*group).agg(row.alias("newest")).select("newest.*")


def latest_artifact(artifacts: DataFrame, tie_break: str = "name") -> DataFrame:
    """The newest artifact, no row if there is none."""
    return artifacts.orderBy(F.desc("modified_at"), F.desc(tie_break)).limit(1)


def latest_by_name(artifacts: DataFrame) -> DataFrame:
    """The artifact last in name order, whatever its time; no row if there is none."""
    return artifacts.orderBy(F.desc("name")).limit(1)


def latest_per_table(artifacts: DataFrame, tie_break: str = "name") -> DataFrame:
    """The newest artifact of every table that is not gone by then."""
    return present(_newest(artifacts, tie_break, ["table_name"]))


def required(found: DataFrame, message: str) -> DataFrame:
    """The same rows; raises if there are none."""
    if found.isEmpty():
        raise NoArtifactError(message)
    return found


def find_by_name(artifacts: DataFrame, text: str, tie_break: str = "name") -> DataFrame:
    """The newest artifact whose name contains ``text``."""
    matches = artifacts.where(F.col("name").contains(text))
    return required(latest_artifact(matches, tie_break), f"no artifact named like {text!r}")


def find_by_date(
    artifacts: DataFrame, day: date | str, tie_break: str = "name", exact_name: bool = False
) -> DataFrame:
    """The newest artifact of a day.

    With ``exact_name`` it must carry the dated name ``backup_<yyyymmdd>.sql.gz``;
    otherwise its time must fall on the day, a range the scan can push down.
    """
    start = moment(day)
    if exact_name:
        matches = artifacts.where(base_name(F.col("name")) == backup_name_for_day(start))
    else:
        end: Column = start + F.expr("INTERVAL 1 DAY")
        matches = artifacts.where(
            (F.col("modified_at") >= start) & (F.col("modified_at") < end)
        )
    return required(latest_artifact(matches, tie_break), f"no artifact of {day}")


def restore_chain(
    artifacts: DataFrame, as_of: datetime | str, tie_break: str = "name"
) -> DataFrame:
    """Per table, what a restore as of a time goes through, numbered in order.

    That is the newest full copy at or before ``as_of`` and the incremental
    copies after it up to ``as_of``. A table without a full copy by then, or gone
    by then, has no chain.
    """
    until = artifacts.where(F.col("modified_at") <= moment(as_of))
    full, gone = F.col("kind") == "full", F.col("kind") == "dropped"
    chain = since_last(until, "table_name", "modified_at", tie_break, full, gone)
    return number_in_order(chain, "table_name", "modified_at", tie_break, "step")


def restore_points(
    artifacts: DataFrame, as_of: datetime | str, tie_break: str = "name"
) -> DataFrame:
    """Per table, the copy to read for a restore as of a time: the last of its chain.

    Copies are whole tables, so that is the newest copy, of any kind, of each
    table which has a full copy by then.
    """
    until = artifacts.where(F.col("modified_at") <= moment(as_of))
    row = F.max_by(F.struct(*artifacts.columns), F.struct("modified_at", tie_break))
    return (
        until.groupBy("table_name")
        .agg(row.alias("newest"), F.bool_or(F.col("kind") == "full").alias("has_base"))
        .where("has_base AND NOT newest.kind <=> 'dropped'")
        .select("newest.*")
    )


def storage_usage(artifacts: DataFrame) -> DataFrame:
    """Artifacts and bytes per table and kind, per table, and in all.

    ``level`` is 0 for a table and kind, 1 for a table, 3 for everything.
    """
    return (
        present(artifacts).rollup("table_name", "kind")
        .agg(
            F.count(F.lit(1)).alias("artifacts"),
            F.sum("size_bytes").alias("size_bytes"),
            F.grouping_id().cast("int").alias("level"),
        )
        .withColumn("size", readable(F.col("size_bytes")))
    )
