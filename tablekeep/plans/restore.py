"""Restoring table sets: choose the copies, check them, then touch the target."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from datetime import datetime
from urllib.parse import quote

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T

from tablekeep.functions.hashing import quoted
from tablekeep.operators.selection import select_tables
from tablekeep.plans.copies import measure, read_copy, same_shape, schema_of, write_copy
from tablekeep.plans.jobs import run_jobs
from tablekeep.plans.journal import recover, swap
from tablekeep.plans.manifest import copies_as_of, read_manifest
from tablekeep.plans.snapshot import DEFAULT_PARALLELISM
from tablekeep.sources import files
from tablekeep.sources.small import small_frame
from tablekeep.sources.tables import FrameTables, ParquetTables, in_quotes

MODES = ("error", "append", "force")
VALIDATION = (
    "name string, schema_name string, table_name string, snapshot_id string, has_schema boolean,"
    " has_data boolean, row_count_ok boolean, fingerprint_ok boolean, valid boolean, error string"
)


class TargetExistsError(RuntimeError):
    """The target of a restore already holds a table to be restored."""


class InvalidSnapshotError(RuntimeError):
    """A copy does not hold what its manifest row says."""


def chosen_copies(
    spark: SparkSession,
    root: str,
    as_of: datetime | str | None = None,
    snapshot_id: str | None = None,
    tables: str | Iterable[str] | None = None,
    schemas: str | Iterable[str] | None = None,
) -> DataFrame:
    """Manifest rows of the copies to restore: the newest per table, as of a time,
    or those of one snapshot; raises if there are none."""
    manifest = read_manifest(spark, root.rstrip("/"))
    if snapshot_id is not None:
        manifest = manifest.where(F.col("snapshot_id") == snapshot_id)
        copies = manifest.where("status = 'ok'")
    else:
        copies = copies_as_of(manifest, as_of)
    keys = ["schema_name", "table_name"]
    wanted = select_tables(copies.select(*keys), schemas=schemas, only=tables)
    return copies.join(wanted.select(*keys), keys, "left_semi")


def _rows(copies: DataFrame) -> list[Row]:
    """The manifest rows of copies, the largest first."""
    return sorted(copies.collect(), key=lambda copy: -copy["size_bytes"])


def _read(spark: SparkSession, copy: Row) -> DataFrame:
    return read_copy(spark, copy["path"], copy["format"], copy["schema_json"], copy["chain"])


def restored_tables(
    spark: SparkSession,
    root: str,
    as_of: datetime | str | None = None,
    snapshot_id: str | None = None,
    tables: str | Iterable[str] | None = None,
    schemas: str | Iterable[str] | None = None,
) -> FrameTables:
    """The tables as they were, to be read where they lie, as a table source."""
    copies = chosen_copies(spark, root, as_of, snapshot_id, tables, schemas).collect()
    if not copies:
        raise LookupError(f"nothing to restore in {root}")
    return FrameTables(
        spark, {(c["schema_name"], c["table_name"]): _read(spark, c) for c in copies}
    )


def _check(spark: SparkSession, copy: Row) -> dict:
    """Read a copy again and hold it against its manifest row.

    Parquet files know their columns, and these must be the manifest's; text files
    are read with the manifest's and fail if they do not fit.
    """
    known = schema_of(copy["schema_json"])
    if copy["format"] == "parquet" and copy["row_count"]:
        reader = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true")
        stored = reader.parquet(copy["path"]).schema
        has_schema = same_shape(stored, known)
    else:
        has_schema = True
    found = measure(_read(spark, copy))
    same = {key: found[key] == copy[key] for key in ("row_count", "fingerprint")}
    return {**same, "has_schema": has_schema}


def validate_copies(
    spark: SparkSession, copies: DataFrame, parallelism: int = DEFAULT_PARALLELISM
) -> DataFrame:
    """One row per copy: schema and files there, row count and fingerprint as noted.

    A copy that cannot be read is invalid and stops no other check.
    """
    rows = []
    checked = run_jobs(spark, lambda c: _check(spark, c), _rows(copies), parallelism)
    for copy, same, error in checked:
        same = same or {"row_count": False, "fingerprint": False, "has_schema": False}
        has_schema, has_data = same["has_schema"], error is None
        rows.append(
            (
                f"{copy['schema_name']}.{copy['table_name']}",
                copy["schema_name"],
                copy["table_name"],
                copy["snapshot_id"],
                has_schema,
                has_data,
                same["row_count"],
                same["fingerprint"],
                has_schema and has_data and same["row_count"] and same["fingerprint"],
                None if error is None else f"{type(error).__name__}: {error}",
            )
        )
    return small_frame(spark, rows, VALIDATION)


def validate_snapshot(
    spark: SparkSession,
    root: str,
    snapshot_id: str | None = None,
    as_of: datetime | str | None = None,
    parallelism: int = DEFAULT_PARALLELISM,
) -> DataFrame:
    """:func:`validate_copies` for one snapshot, or for what a restore would read."""
    return validate_copies(spark, chosen_copies(spark, root, as_of, snapshot_id), parallelism)


def _require_valid(spark: SparkSession, copies: DataFrame, parallelism: int) -> None:
    bad = validate_copies(spark, copies, parallelism).where("NOT valid").select("name").collect()
    if bad:
        raise InvalidSnapshotError(f"not restored, invalid: {', '.join(r[0] for r in bad)}")


def _mode(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    return mode


def _raise_first(outcomes: list) -> None:
    for _, _, error in outcomes:
        if error is not None:
            raise error


def _stage(spark: SparkSession, copy: Row, path: str) -> str:
    """Write a copy to a new path, checking on the way that it is what was saved."""
    written = write_copy(_read(spark, copy), path)
    if any(written[key] != copy[key] for key in ("row_count", "fingerprint")):
        raise InvalidSnapshotError(f"not restored, invalid: {copy['table_name']}")
    return path


def _report(spark: SparkSession, rows: list[Row], targets: list[str]) -> DataFrame:
    return small_frame(
        spark,
        [
            (c["schema_name"], c["table_name"], c["snapshot_id"], c["row_count"], target)
            for c, target in zip(rows, targets)
        ],
        "schema_name string, table_name string, snapshot_id string, row_count bigint,"
        " target string",
    )


def _folder(copy: Row) -> str:
    """Where a table goes below a target; what means something in a path is escaped."""
    return "/".join(quote(copy[key], safe="") for key in ("schema_name", "table_name"))


def _require_same_shape(targets: Iterable[tuple[Row, T.StructType, str]]) -> None:
    """Rows are only added to tables of the same columns."""
    other = [place for c, found, place in targets if not same_shape(found, schema_of(c["schema_json"]))]
    if other:
        raise TargetExistsError(f"other columns than the copies: {', '.join(other)}")


def restore_to_folder(
    spark: SparkSession,
    copies: DataFrame,
    target: str,
    mode: str = "error",
    parallelism: int = DEFAULT_PARALLELISM,
) -> DataFrame:
    """Restore into ``<target>/<schema>/<table>.parquet``; reports one row per table.

    - ``error``: refuses if any of the tables is there;
    - ``force``: replaces them; other tables stay;
    - ``append``: adds the rows to what is there, if its columns are the same.

    All tables are first written beside the target, and checked while they are;
    only when every one is right are they, or for ``append`` their files, renamed
    into place: all of them or none, also if the process dies (see ``plans.journal``).
    What an earlier restore left half done is ended first.
    """
    _mode(mode)
    target = target.rstrip("/")
    recover(spark, target)
    rows = _rows(copies)
    places = [f"{target}/{_folder(c)}{ParquetTables.SUFFIX}" for c in rows]
    if mode == "append":
        _require_same_shape(
            (c, spark.read.option("mergeSchema", "true").parquet(p).schema, p)
            for c, p in zip(rows, places)
            if files.exists(spark, p)
        )
    taken = [p for p in places if files.exists(spark, p)]
    if taken and mode == "error":
        raise TargetExistsError(f"already there: {', '.join(taken)}; restore with force")
    token = uuid.uuid4().hex
    staging = f"{target}/_restore-{token}"
    staged = run_jobs(
        spark,
        lambda c: _stage(spark, c, f"{staging}/new/{_folder(c)}"),
        rows,
        parallelism,
    )
    bad = [error for _, _, error in staged if error is not None]
    if bad:
        files.delete(spark, staging)
        raise bad[0]
    new = [path for _, path, _ in staged]
    if mode == "append":
        moves = [
            [f"{path}/{name}", f"{place}/{token}-{name}"]
            for path, place in zip(new, places)
            for name in files.children(spark, path)
        ]
        swap(spark, target, token, "files", moves, staging)
    else:
        moves = [
            [path, place, f"{staging}/old/{_folder(c)}", place in taken]
            for c, path, place in zip(rows, new, places)
        ]
        swap(spark, target, token, "folders", moves, staging)
    return _report(spark, rows, places)


def restore_to_catalog(
    spark: SparkSession,
    copies: DataFrame,
    location: str,
    mode: str = "error",
    database: str | None = None,
    parallelism: int = DEFAULT_PARALLELISM,
) -> DataFrame:
    """Restore into tables of the session's catalog, one database per schema.

    Each table gets a new folder below ``location``, written and checked before
    the catalog is touched; then the catalog is pointed at it. No file is renamed,
    which suits object stores, and the folder a replaced table used stays. Tables
    whose files the catalog would delete with them (managed ones) are not replaced.
    New tables are made under other names first; then all entries are renamed, or
    none, also if the process dies (see ``plans.journal``): the next restore to the
    location ends it. ``append`` inserts into the tables that are there, if their
    columns are the same.
    """
    _mode(mode)
    location = location.rstrip("/")
    recover(spark, location)
    rows = _rows(copies)
    names = [f"{quoted(database or c['schema_name'])}.{quoted(c['table_name'])}" for c in rows]
    there = {name: spark.catalog.tableExists(name) for name in names}
    taken = [name for name in names if there[name]]
    if taken and mode == "error":
        raise TargetExistsError(f"already there: {', '.join(taken)}; restore with force")
    if mode == "force":
        managed = [n for n in taken if spark.catalog.getTable(n).tableType == "MANAGED"]
        if managed:
            raise TargetExistsError(f"managed tables, move or drop them: {', '.join(managed)}")
    if mode == "append":
        _require_same_shape(
            (c, spark.table(name).schema, name) for c, name in zip(rows, names) if there[name]
        )
    for schema in sorted({database or c["schema_name"] for c in rows}):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(schema)}")
    fresh = [(c, n) for c, n in zip(rows, names) if mode != "append" or not there[n]]
    grown = [(c, n) for c, n in zip(rows, names) if mode == "append" and there[n]]
    if grown:
        _require_valid(spark, copies, parallelism)
    token = uuid.uuid4().hex
    staged = run_jobs(
        spark,
        lambda pair: _stage(
            spark,
            pair[0],
            f"{location}/{_folder(pair[0])}-{token}",
        ),
        fresh,
        parallelism,
    )
    _raise_first(staged)
    moves = []
    for number, ((copy, _), path, _) in enumerate(staged):
        home, schema = database or copy["schema_name"], schema_of(copy["schema_json"])
        new = f"restore_{token}_{number}"
        spark.catalog.createTable(f"{quoted(home)}.{quoted(new)}", path=path, source="parquet", schema=schema)
        moves.append([home, new, copy["table_name"], f"{new}_old"])
    swap(spark, location, token, "tables", moves)
    _raise_first(
        run_jobs(
            spark,
            lambda pair: _read(spark, pair[0]).write.mode("append").saveAsTable(pair[1]),
            grown,
            parallelism,
        )
    )
    return _report(spark, rows, names)


def _jdbc_table_exists(spark: SparkSession, url: str, name: str, options: dict[str, str]) -> bool:
    """Whether a table can be asked for its columns."""
    settings = {"url": url, "query": f"SELECT * FROM {name} WHERE 1 = 0", **options}
    try:
        return bool(spark.read.format("jdbc").options(**settings).load().columns)
    except Exception as error:  # each driver has errors of its own for a missing table
        text = str(error).lower()
        if "exist" in text or "not found" in text or "unknown" in text:
            return False
        raise


def restore_to_jdbc(
    spark: SparkSession,
    copies: DataFrame,
    url: str,
    mode: str = "error",
    options: dict[str, str] | None = None,
    parallelism: int = DEFAULT_PARALLELISM,
) -> DataFrame:
    """Restore into a database behind JDBC, after all copies were checked.

    ``force`` empties a table that is there before it is filled again; the two
    steps are not one transaction of the database.
    """
    save_mode = {"error": "errorifexists", "append": "append", "force": "overwrite"}[_mode(mode)]
    _require_valid(spark, copies, parallelism)
    rows = _rows(copies)
    names = [f"{in_quotes(c['schema_name'])}.{in_quotes(c['table_name'])}" for c in rows]
    if mode == "error":
        taken = [n for n in names if _jdbc_table_exists(spark, url, n, options or {})]
        if taken:
            raise TargetExistsError(f"already there: {', '.join(taken)}; restore with force")

    def work(pair: tuple[Row, str]) -> None:
        settings = {"url": url, "dbtable": pair[1], "truncate": "true", **(options or {})}
        _read(spark, pair[0]).write.format("jdbc").options(**settings).mode(save_mode).save()

    _raise_first(run_jobs(spark, work, list(zip(rows, names)), parallelism))
    return _report(spark, rows, names)
