"""``spark-submit`` or ``python -m tablekeep <command>``: backup, restore, list, validate, rotate.

Tables are Parquet tables below ``--source``, those of a database behind
``--jdbc-url`` or, without either, those of the session's catalog. ``list`` and
``rotate`` also take plain files: ``--files`` names their folder.
"""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from tablekeep.functions.times import DEFAULT_RETENTION_DAYS, RULES
from tablekeep.operators.catalogue import artifact_list, from_manifest, snapshots, storage_usage
from tablekeep.operators.change import changed_since
from tablekeep.operators.selection import select_tables
from tablekeep.plans.manifest import read_manifest
from tablekeep.plans.restore import (
    MODES,
    chosen_copies,
    restore_to_catalog,
    restore_to_folder,
    restore_to_jdbc,
    validate_snapshot,
)
from tablekeep.plans.rotation import retention_apply, rotate_files
from tablekeep.plans.snapshot import DEFAULT_PARALLELISM, SnapshotOptions
from tablekeep.plans.workflow import back_up, find_snapshot
from tablekeep.sources.artifacts import list_files
from tablekeep.sources.tables import CatalogTables, JdbcTables, ParquetTables


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tablekeep")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        added = commands.add_parser(name, help=text)
        plain = name in ("list", "rotate")  # these may be about plain files
        added.add_argument("--root", required=not plain, help="folder the snapshots are in")
        return added

    backup = command("backup", "take a snapshot, then rotate")
    backup.add_argument("--source", help="folder of Parquet tables")
    backup.add_argument("--schema", default="public", help="schema of the tables in --source")
    backup.add_argument("--schemas", help="schemas to take, comma-separated")
    backup.add_argument("--exclude-schemas")
    backup.add_argument("--tables", help="tables to take, comma-separated")
    backup.add_argument("--exclude-tables")
    backup.add_argument("--backup-name", help="id of the snapshot; the time if left out")
    backup.add_argument("--incremental", action="store_true", help="changed tables only")
    backup.add_argument("--since", help="with --jdbc-url: tables analysed after this time")
    backup.add_argument("--format", choices=["parquet", "json"], default="parquet")
    backup.add_argument("--parallel-jobs", type=int, default=DEFAULT_PARALLELISM)

    restore = command("restore", "restore the newest, a named or a day's snapshot")
    where = restore.add_mutually_exclusive_group(required=True)
    where.add_argument("--target", help="folder to restore into")
    where.add_argument("--catalog", help="restore into the session's catalog, files below this folder")
    where.add_argument("--jdbc-url", help="restore into a database")
    restore.add_argument("--backup-name", help="text the snapshot id contains")
    restore.add_argument("--date", help="day of the snapshot, yyyy-mm-dd")
    restore.add_argument("--schemas")
    restore.add_argument("--tables")
    how = restore.add_mutually_exclusive_group()
    how.add_argument("--force", action="store_const", const="force", dest="mode")
    how.add_argument("--append", action="store_const", const="append", dest="mode")
    restore.set_defaults(mode=MODES[0])

    listed = command("list", "list the snapshots, or plain files")
    command("usage", "storage used per table and kind")
    validate = command("validate", "check the copies of the newest or a named snapshot")
    validate.add_argument("--backup-name")
    rotate = command("rotate", "remove copies, or plain files, out of retention")
    backup.add_argument("--jdbc-url", help="database to take tables from")
    for added in (backup, restore):
        added.add_argument(
            "--jdbc-option", action="append", default=[], metavar="KEY=VALUE",
            help="option of the database's reader or writer, such as user or driver",
        )
    for added in (listed, rotate):
        added.add_argument("--files", help="folder of plain files, instead of --root")
        added.add_argument("--pattern", default="backup_*", help="names of plain files")
    for added in (backup, rotate):
        added.add_argument("--retention-days", type=int, default=DEFAULT_RETENTION_DAYS)
        added.add_argument("--rule", choices=RULES, default="exact")
    return parser


def _options(args: argparse.Namespace) -> dict[str, str]:
    return dict(option.split("=", 1) for option in args.jdbc_option)


def report(spark: SparkSession, arguments: list[str]) -> DataFrame:
    """What a command line asks for, as a frame: a report, or the paths removed."""
    args = _parser().parse_args(arguments)
    if args.command == "backup":
        if args.since and not (args.jdbc_url and args.incremental):
            raise SystemExit("--since needs --jdbc-url and --incremental")
        if args.source:
            source = ParquetTables(spark, args.source, args.schema)
        elif args.jdbc_url:
            source = JdbcTables(spark, args.jdbc_url, _options(args))
        else:
            source = CatalogTables(spark)
        tables = select_tables(
            source.tables(), args.schemas, args.exclude_schemas, args.tables, args.exclude_tables
        )
        return back_up(
            source,
            args.root,
            args.backup_name,
            incremental=args.incremental,
            tables=tables,
            changed=changed_since(source.table_stats(), args.since) if args.since else None,
            retention_days=args.retention_days,
            rule=args.rule,
            options=SnapshotOptions(format=args.format, parallelism=args.parallel_jobs),
        )
    if args.command == "restore":
        found = find_snapshot(spark, args.root, args.backup_name, args.date)
        copies = chosen_copies(
            spark, args.root, found["modified_at"], None, args.tables, args.schemas
        )
        if args.catalog:
            return restore_to_catalog(spark, copies, args.catalog, args.mode)
        if args.jdbc_url:
            return restore_to_jdbc(spark, copies, args.jdbc_url, args.mode, _options(args))
        return restore_to_folder(spark, copies, args.target, args.mode)
    if args.command == "validate":
        found = find_snapshot(spark, args.root, args.backup_name)
        return validate_snapshot(spark, args.root, as_of=found["modified_at"])
    if args.command in ("list", "rotate") and not (args.root or args.files):
        raise SystemExit("one of --root and --files is needed")
    if args.command == "rotate":
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        if args.files:
            return rotate_files(
                spark, args.files, now, args.pattern, args.retention_days, args.rule
            )
        return retention_apply(spark, args.root, now, args.retention_days, args.rule)
    if args.command == "list" and args.files:
        return artifact_list(list_files(spark, args.files, args.pattern))
    manifest = read_manifest(spark, args.root.rstrip("/"))
    if args.command == "usage":
        return storage_usage(from_manifest(manifest))
    return artifact_list(snapshots(manifest))


def run(spark: SparkSession, arguments: list[str]) -> DataFrame | list[str]:
    """What a command line asks for: a report, or the paths removed as a list."""
    found = report(spark, arguments)
    return [r["path"] for r in found.toLocalIterator()] if arguments[0] == "rotate" else found


def main(arguments: list[str] | None = None) -> int:
    spark = (
        SparkSession.builder.appName("tablekeep")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    result = report(spark, sys.argv[1:] if arguments is None else arguments)
    print("\t".join(result.columns))
    for row in result.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))
    return 0 if "valid" not in result.columns or result.where("NOT valid").isEmpty() else 1


if __name__ == "__main__":
    sys.exit(main())
