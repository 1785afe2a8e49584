"""Snapshots of table sets: full, several at once, incremental."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, functions as F

from tablekeep.operators.selection import select_tables
from tablekeep.operators.bags import is_groupable
from tablekeep.plans.copies import (
    DELTA,
    measure,
    read_chain,
    read_copy,
    same_shape,
    schema_of,
    small_rows,
    write_copy,
    write_delta,
    write_sketches,
)
from tablekeep.plans.jobs import run_jobs
from tablekeep.plans.manifest import (
    append_manifest,
    copy_folder,
    copies_as_of,
    new_run_id,
    read_log,
    read_manifest,
)
from tablekeep.sources import files
from tablekeep.sources.small import small_frame
from tablekeep.sources.tables import FileState, TableSource

DEFAULT_PARALLELISM = 4
REPORT = (
    "snapshot_id string, kind string, schema_name string, table_name string, change string,"
    " row_count bigint, size_bytes bigint, status string, error string"
)


class SnapshotError(RuntimeError):
    """Some tables could not be written; the manifest names them."""


class NoBaseError(RuntimeError):
    """An incremental snapshot was asked for where no full one exists."""


@dataclass(frozen=True)
class SnapshotOptions:
    """How copies are written.

    ``format`` is ``parquet`` or ``json`` (gzip JSON lines). ``on_error`` is
    ``raise`` (after all tables were tried) or ``record``. With ``verify`` every
    copy is read again before the manifest calls it good. Without, its row count
    and fingerprint are noted as it is written, and whatever restores it checks it.
    ``buckets`` lays copies out by buckets with a hash tree, so that two copies can be
    compared by reading what differs; ``keys`` (table name -> columns) say by what,
    and a table without keys is laid out by whole rows. With ``deltas`` an incremental
    copy holds only the rows that came and went, unless it would be the
    ``longest_chain``-th in a row or these were more than ``most_changed`` of the table:
    then it is a whole copy, on which the next ones are built. ``sketches`` keeps sketches
    of distinct values and quantiles with each whole copy, which are merged over copies
    without reading them (``copies.copy_sketches``).
    """

    format: str = "parquet"
    compression: str | None = None
    max_records_per_file: int = 0
    parallelism: int = DEFAULT_PARALLELISM
    on_error: str = "raise"
    verify: bool = False
    buckets: int = 0
    keys: Mapping[str, Sequence[str]] = field(default_factory=dict)
    deltas: bool = False
    longest_chain: int = 8
    most_changed: float = 0.5
    sketches: bool = False


@dataclass(frozen=True)
class _Run:
    source: TableSource
    root: str
    snapshot_id: str
    run_id: str
    at: datetime
    options: SnapshotOptions
    states: dict[tuple[str, str], FileState]
    kind: str

    def token(self, table: tuple[str, str]) -> str | None:
        state = self.states.get(table)
        return None if state is None else state.token

    def folder(self, table: tuple[str, str]) -> str:
        return copy_folder(self.root, *table, self.snapshot_id, self.run_id)

    def row(self, table: tuple[str, str], kind: str, change: str, status: str, **more) -> dict:
        return {
            "snapshot_id": self.snapshot_id,
            "run_id": self.run_id,
            "kind": kind,
            "schema_name": table[0],
            "table_name": table[1],
            "change": change,
            "path": "",
            "format": self.options.format,
            "source_state": self.token(table),
            "created_at": self.at,
            "status": status,
            "run_kind": self.kind,
            **more,
        }

    def record(self, row: dict) -> dict:
        """Put a table's row into the manifest as soon as the table is done."""
        append_manifest(self.source.spark, self.root, [row])
        return row

    def write(self, table: tuple[str, str], kind: str, change: str) -> dict:
        spark, options = self.source.spark, self.options
        path = self.folder(table)
        df = self.source.read(*table)
        written = write_copy(
            df,
            path,
            format=options.format,
            compression=options.compression,
            max_records_per_file=options.max_records_per_file,
            buckets=options.buckets,
            keys=options.keys.get(table[1], ()),
        )
        schema_json = df.schema.json()
        if options.sketches:
            write_sketches(spark, read_copy(spark, path, options.format, schema_json), path)
        if options.verify:
            found = measure(read_copy(spark, path, options.format, schema_json))
            if found != written:
                raise SnapshotError(f"{path} holds {found}, written were {written}")
        return self.record(
            self.row(
                table,
                kind,
                change,
                "ok",
                path=path,
                schema_json=schema_json,
                size_bytes=files.size_bytes(spark, path),
                **written,
            )
        )


    def write_changes(self, table: tuple[str, str], copy, now: dict | None = None) -> dict:
        """A copy of what changed since another one, or a whole one if that is better; ``now`` has
        the table's row count and fingerprint if they are known."""
        spark, options = self.source.spark, self.options
        new, schema = self.source.read(*table), schema_of(copy["schema_json"])
        chain = [*(copy["chain"] or ()), copy["path"]]
        whole = copy["format"] not in ("parquet", DELTA) or len(chain) >= options.longest_chain
        if whole or not same_shape(new.schema, schema) or not is_groupable(schema):
            return self.write(table, "incremental", "changed")
        path, now = self.folder(table), now or measure(new)
        old, deltas = read_chain(spark, copy["path"], copy["format"], copy["schema_json"], copy["chain"])
        delta = write_delta(old, new, path, deltas, small_rows(spark, chain[0], copy["row_count"]))
        if delta["rows"] > options.most_changed * max(now["row_count"], 1):
            files.delete(spark, path)
            return self.write(table, "incremental", "changed")
        # counts and hashes add up, so what the chain makes need not be made to be checked
        made = {key: copy[key] + delta[key] for key in now}
        if made != now:
            raise SnapshotError(f"{path} makes {made}, the table has {now}")
        return self.record(
            self.row(
                table, "incremental", "changed", "ok", path=path, format=DELTA, chain=chain,
                schema_json=copy["schema_json"], size_bytes=files.size_bytes(spark, path), **now,
            )
        )


def _start(
    source: TableSource,
    root: str,
    snapshot_id: str | None,
    at: datetime | None,
    options: SnapshotOptions,
    tables: list[tuple[str, str]],
    kind: str,
) -> _Run:
    at = at or datetime.now(timezone.utc).replace(tzinfo=None)
    return _Run(
        source=source,
        root=root.rstrip("/"),
        snapshot_id=snapshot_id or f"{at:%Y%m%d_%H%M%S_%f}",
        run_id=new_run_id(),
        at=at,
        options=options,
        # Taken before any table is read: a file that changes later shows as changed.
        states=source.states(tables),
        kind=kind,
    )


def _refuse_other_kind(run: _Run, log: DataFrame) -> None:
    """An id belongs to full runs or to incremental ones; both under one would hide copies."""
    others = log.where(
        (F.col("snapshot_id") == run.snapshot_id)
        & (F.coalesce("run_kind", "kind") != run.kind)
        & (F.col("status") != "failed")
    )
    if not others.isEmpty():
        raise ValueError(f"snapshot id {run.snapshot_id} is that of a run of another kind")


def _done_before(run: _Run, log: DataFrame) -> dict[tuple[str, str], dict]:
    """Good copies made under this id since its last run that came to its end."""
    own = log.where(F.col("snapshot_id") == run.snapshot_id)
    last_end = own.agg(F.max(F.when(F.col("status") == "closed", F.col("run_id")))).first()[0]
    left = own.where((F.col("status") == "ok") & (F.col("run_id") > (last_end or "")))
    rows = sorted(left.collect(), key=lambda r: r["run_id"])
    return {(r["schema_name"], r["table_name"]): r.asDict() for r in rows}


def _largest_first(run: _Run, tables: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Large tables start early, so that none is left running alone at the end."""
    sizes = {table: state.size_bytes for table, state in run.states.items()}
    return sorted(tables, key=lambda table: -sizes.get(table, 0))


def _table_names(tables: DataFrame) -> list[tuple[str, str]]:
    return sorted((r[0], r[1]) for r in tables.select("schema_name", "table_name").collect())


def _finish(run: _Run, outcomes: list, kind: str) -> DataFrame:
    """Note failures, close a run without any, and report on every table."""
    rows, failures = [], []
    for table, row, error in outcomes:
        if error is not None:
            text = f"{type(error).__name__}: {error}"
            row = run.row(table, kind, "", "failed", path=run.folder(table), error=text)
            failures.append(row)
        rows.append(row)
    spark = run.source.spark
    end = [] if failures else [run.row(("", ""), kind, "", "closed")]
    append_manifest(spark, run.root, failures + end)
    failed = [f"{r['schema_name']}.{r['table_name']}" for r in failures]
    if failed and run.options.on_error == "raise":
        raise SnapshotError(f"snapshot {run.snapshot_id}: could not write {', '.join(failed)}")
    return small_frame(spark, rows, REPORT)


def snapshot_full(
    source: TableSource,
    root: str,
    snapshot_id: str | None = None,
    at: datetime | None = None,
    tables: DataFrame | None = None,
    options: SnapshotOptions = SnapshotOptions(),
) -> DataFrame:
    """Copy a table set and report one row per table. A root is for one source.

    ``tables`` comes from :func:`select_tables`; without it all tables but those
    of system schemas are taken. Up to ``options.parallelism`` tables are written
    at a time, each as one distributed write. An id may be used again: a run that
    died or failed is taken up where it stopped, after one that was closed the
    tables are copied anew, and tables not asked for this time keep their copies.
    """
    chosen = _table_names(select_tables(source.tables()) if tables is None else tables)
    run = _start(source, root, snapshot_id, at, options, chosen, "full")
    log = read_log(source.spark, run.root)
    _refuse_other_kind(run, log)
    done = _done_before(run, log)

    def work(table: tuple[str, str]) -> dict:
        if table in done:
            return {**done[table], "change": "full"}
        return run.write(table, "full", "full")

    outcomes = run_jobs(source.spark, work, _largest_first(run, chosen), options.parallelism)
    return _finish(run, outcomes, "full")


def snapshot_schemas(
    source: TableSource,
    root: str,
    schemas: str | list[str] | None = None,
    snapshot_id: str | None = None,
    at: datetime | None = None,
    options: SnapshotOptions = SnapshotOptions(),
) -> DataFrame:
    """Copy several schemas at once, all of them if none is named."""
    chosen = select_tables(source.tables(), schemas=schemas)
    return snapshot_full(source, root, snapshot_id, at, chosen, options)


def snapshot_incremental(
    source: TableSource,
    root: str,
    snapshot_id: str | None = None,
    at: datetime | None = None,
    tables: DataFrame | None = None,
    changed: DataFrame | None = None,
    options: SnapshotOptions = SnapshotOptions(),
) -> DataFrame:
    """Copy the tables that changed since the newest copies, each whole.

    ``changed`` (schema_name, table_name) says which, as ``changed_since`` finds
    them from statistics. Without it the tables of the set are compared with
    their newest copies, cheapest test first: stored files, schema, row count,
    fingerprint. Only the last needs a scan. A table seen for the first time gets
    a full copy, and a table that is gone gets a row without data.
    """
    spark = source.spark
    if changed is not None:
        chosen = _table_names(changed)
    else:
        chosen = _table_names(select_tables(source.tables()) if tables is None else tables)
    run = _start(source, root, snapshot_id, at, options, chosen, "incremental")
    _refuse_other_kind(run, read_log(spark, run.root))
    manifest = read_manifest(spark, run.root)
    if manifest.where("kind = 'full' AND status = 'ok'").isEmpty():
        raise NoBaseError("an incremental snapshot needs a full one before it")
    base = {
        (r["schema_name"], r["table_name"]): r for r in copies_as_of(manifest, run.at).collect()
    }
    gone = set() if changed is not None else set(base) - set(_table_names(source.tables()))

    def work(table: tuple[str, str]) -> dict:
        now = None
        if changed is not None:
            change = "changed" if table in base else "new"
        else:
            change, now = _change(run, table, base.get(table))
        if change == "unchanged":
            return run.row(table, "incremental", change, "unchanged", **_known(base[table]))
        if change == "changed" and options.deltas:
            return run.write_changes(table, base[table], now)
        return run.write(table, "full" if change == "new" else "incremental", change)

    outcomes = run_jobs(spark, work, _largest_first(run, chosen), options.parallelism)
    outcomes += [
        (table, run.record(run.row(table, "incremental", "dropped", "dropped")), None)
        for table in sorted(gone)
    ]
    return _finish(run, outcomes, "incremental")


def _known(copy) -> dict:
    return {"row_count": copy["row_count"], "size_bytes": copy["size_bytes"]}


def _change(run: _Run, table: tuple[str, str], copy) -> tuple[str, dict | None]:
    """What became of a table since a copy, and its row count and fingerprint if these had to be found."""
    if copy is None:
        return "new", None
    token = run.token(table)
    if token is not None and token == copy["source_state"]:
        return "unchanged", None
    df = run.source.read(*table)
    if not same_shape(df.schema, schema_of(copy["schema_json"])):
        return "changed", None
    if run.source.cheap_count and df.count() != copy["row_count"]:
        return "changed", None
    now = measure(df)
    same = all(now[key] == copy[key] for key in ("row_count", "fingerprint"))
    return ("unchanged" if same else "changed"), now


def table_measures(
    source: TableSource, tables: DataFrame | None = None, parallelism: int = DEFAULT_PARALLELISM
) -> DataFrame:
    """row_count, fingerprint and schema of every table of a set, one row each."""
    spark = source.spark
    chosen = _table_names(select_tables(source.tables()) if tables is None else tables)

    def work(table: tuple[str, str]) -> dict:
        df = source.read(*table)
        return {**measure(df), "schema_json": df.schema.json()}

    outcomes = run_jobs(spark, work, chosen, parallelism)
    for _, _, error in outcomes:
        if error is not None:
            raise error
    return small_frame(
        spark,
        [
            (*table, m["row_count"], m["fingerprint"], m["schema_json"])
            for table, m, _ in outcomes
        ],
        "schema_name string, table_name string, row_count bigint, fingerprint decimal(38,0),"
        " schema_json string",
    )
