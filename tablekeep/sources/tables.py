"""Where tables come from.

A source lists its tables (``schema_name``, ``table_name``) and reads one of
them as a DataFrame. ``states`` may tell from the stored files alone that a
table did not change, which spares it the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablekeep.functions.hashing import quoted
from tablekeep.operators.ranges import equi_depth
from tablekeep.sources import files
from tablekeep.sources.small import small_frame

def in_quotes(name: str) -> str:
    """A name as databases quote it."""
    return '"' + name.replace('"', '""') + '"'


TABLES_DDL = "schema_name string, table_name string"


@dataclass(frozen=True)
class FileState:
    """A token that changes whenever the files of a table do, and their bytes."""

    token: str
    size_bytes: int


def _listing_session(spark: SparkSession) -> SparkSession:
    """A session whose scans pack files by their number, not their length.

    Listing reads no content, yet Spark plans one task per 128 MB of files. With
    the limit lifted it spreads the files evenly over the cores there are.
    """
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            session.conf.set(key, value)
    session.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 60))
    return session


class TableSource:
    # Whether counting rows costs next to nothing, as with Parquet footers.
    cheap_count = False

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def tables(self) -> DataFrame:
        raise NotImplementedError

    def read(self, schema_name: str, table_name: str) -> DataFrame:
        raise NotImplementedError

    def states(self, names: list[tuple[str, str]]) -> dict[tuple[str, str], FileState]:
        """A state for each of the tables that has a cheap one."""
        return {}

    def _table_set(self, names: list[tuple[str, str]]) -> DataFrame:
        return small_frame(self.spark, names, TABLES_DDL)


class ParquetTables(TableSource):
    """Tables stored as ``<folder>/<table>.parquet`` (a file or a folder of files).

    ``schema_of`` puts tables into schemas by name; without it all are in
    ``public``.
    """

    SUFFIX = ".parquet"
    cheap_count = True

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        schema_of: Callable[[str], str] | Mapping[str, str] | str = "public",
    ):
        super().__init__(spark)
        self.folder = folder.rstrip("/")
        self._schema_of = schema_of

    def schema_of(self, table_name: str) -> str:
        if isinstance(self._schema_of, str):
            return self._schema_of
        if isinstance(self._schema_of, Mapping):
            return self._schema_of[table_name]
        return self._schema_of(table_name)

    def names(self) -> list[str]:
        found = files.children(self.spark, self.folder)
        return [n[: -len(self.SUFFIX)] for n in found if n.endswith(self.SUFFIX)]

    def tables(self) -> DataFrame:
        return self._table_set([(self.schema_of(n), n) for n in self.names()])

    def read(self, schema_name: str, table_name: str) -> DataFrame:
        if self.schema_of(table_name) != schema_name:
            raise ValueError(f"no table {schema_name}.{table_name} in {self.folder}")
        path = f"{self.folder}/{table_name}{self.SUFFIX}"
        # the columns of all files, from footers read by tasks; unlike types of one column raise
        several = files.is_folder(self.spark, path)
        return self.spark.read.option("mergeSchema", str(several).lower()).parquet(path)

    def states(self, names: list[tuple[str, str]]) -> dict[tuple[str, str], FileState]:
        """File count, bytes and a hash of every file's path, size and time."""
        if not names:
            return {}
        listed = (
            _listing_session(self.spark)
            .read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .load([f"{self.folder}/{table}{self.SUFFIX}" for _, table in names])
            .select("path", "modificationTime", "length")
        )
        base = files.full_path(self.spark, self.folder).split(":", 1)[-1].lstrip("/")
        relative = F.substring_index(F.col("path"), base + "/", -1)
        file_hash = F.xxhash64("path", "modificationTime", "length").cast("decimal(28,0)")
        found = (
            listed.groupBy(F.substring_index(relative, self.SUFFIX, 1).alias("table_name"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("b"), F.sum(file_hash).alias("h"))
            .collect()
        )
        return {
            (self.schema_of(r["table_name"]), r["table_name"]): FileState(
                f"{r['n']}:{r['b']}:{r['h']}", r["b"]
            )
            for r in found
        }


class CatalogTables(TableSource):
    """Tables of the session's catalog, without views; its databases are the schemas."""

    def __init__(self, spark: SparkSession, databases: list[str] | None = None):
        super().__init__(spark)
        self.databases = databases

    def schemas(self) -> list[str]:
        found = [d.name for d in self.spark.catalog.listDatabases()]
        return [d for d in found if self.databases is None or d in self.databases]

    def tables(self) -> DataFrame:
        return self._table_set(
            [
                (database, t.name)
                for database in self.schemas()
                for t in self.spark.catalog.listTables(database)
                if not t.isTemporary and t.tableType != "VIEW"
            ]
        )

    def read(self, schema_name: str, table_name: str) -> DataFrame:
        return self.spark.table(f"{quoted(schema_name)}.{quoted(table_name)}")

    def states(self, names: list[tuple[str, str]]) -> dict[tuple[str, str], FileState]:
        """A state from the files of each table that has any; listing reads no content."""
        found = {}
        for schema_name, table_name in names:
            paths = self.read(schema_name, table_name).inputFiles()
            if not paths:
                continue
            listed = _listing_session(self.spark).read.format("binaryFile").load(sorted(paths))
            file_hash = F.xxhash64("path", "modificationTime", "length").cast("decimal(28,0)")
            n, b, h = listed.agg(F.count(F.lit(1)), F.sum("length"), F.sum(file_hash)).first()
            found[schema_name, table_name] = FileState(f"{n}:{b}:{h}", b)
        return found


class JdbcTables(TableSource):
    """Tables of a database behind JDBC.

    ``partitioning`` maps ``schema.table`` to the reader options that split its
    read (``partitionColumn``, ``lowerBound``, ``upperBound``, ``numPartitions``);
    ``ranges`` maps it to conditions of which each is read by a task of its own, as
    :meth:`key_ranges` finds them. A table in neither is read in one task. A snapshot
    over several tables is not one transaction of the database.
    """

    TABLES_QUERY = (
        "SELECT table_schema AS schema_name, table_name FROM information_schema.tables"
        " WHERE table_type = 'BASE TABLE'"
    )
    # The statistics view and its columns are the database's own.
    STATS_QUERY = (
        "SELECT schemaname AS schema_name, relname AS table_name,"
        " last_analyze, last_autoanalyze FROM pg_stat_user_tables"
    )

    def __init__(
        self,
        spark: SparkSession,
        url: str,
        options: Mapping[str, str] | None = None,
        partitioning: Mapping[str, Mapping[str, str]] | None = None,
        ranges: Mapping[str, Sequence[str]] | None = None,
    ):
        super().__init__(spark)
        self.url = url
        self.ranges = dict(ranges or {})
        self.options = {"fetchsize": "10000", **(options or {})}
        self.partitioning = dict(partitioning or {})

    def read_options(self, schema_name: str, table_name: str) -> dict[str, str]:
        name = f"{schema_name}.{table_name}"
        return {
            "url": self.url,
            "dbtable": f"{in_quotes(schema_name)}.{in_quotes(table_name)}",
            **self.options,
            **self.partitioning.get(name, {}),
        }

    def _query(self, query: str) -> DataFrame:
        options = {"url": self.url, "query": query, **self.options}
        return self.spark.read.format("jdbc").options(**options).load()

    def tables(self) -> DataFrame:
        return self._query(self.TABLES_QUERY)

    def read(self, schema_name: str, table_name: str) -> DataFrame:
        options = self.read_options(schema_name, table_name)
        ranges = self.ranges.get(f"{schema_name}.{table_name}")
        if ranges:
            rest = {k: v for k, v in options.items() if k not in ("url", "dbtable")}
            return self.spark.read.jdbc(
                self.url, options["dbtable"], predicates=list(ranges), properties=rest
            )
        return self.spark.read.format("jdbc").options(**options).load()

    def key_ranges(self, schema_name: str, table_name: str, key: str, parts: int) -> list[str]:
        """Conditions that split a table into parts of about equally many rows, from its key alone."""
        table = f"{in_quotes(schema_name)}.{in_quotes(table_name)}"
        keys = self._query(f"SELECT {in_quotes(key)} FROM {table}")
        return [r.predicate(in_quotes(key)) for r in equi_depth(keys, key, parts)]

    def table_stats(self) -> DataFrame:
        """Per table, when statistics were last gathered by hand and by the system."""
        return self._query(self.STATS_QUERY).select(
            "schema_name",
            "table_name",
            F.col("last_analyze").cast("timestamp_ntz").alias("last_analyze"),
            F.col("last_autoanalyze").cast("timestamp_ntz").alias("last_autoanalyze"),
        )


class FrameTables(TableSource):
    """Tables given as DataFrames under ``(schema, table)``."""

    def __init__(self, spark: SparkSession, frames: Mapping[tuple[str, str], DataFrame]):
        super().__init__(spark)
        self.frames = dict(frames)

    def tables(self) -> DataFrame:
        return self._table_set(sorted(self.frames))

    def read(self, schema_name: str, table_name: str) -> DataFrame:
        return self.frames[schema_name, table_name]
