"""Writing and reading one copy of one table."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from tablekeep.functions.hashing import fingerprint_parts, free_name, row_hash
from tablekeep.operators.bags import delta_schema, folded, signed_delta
from tablekeep.operators.change import row_delta
from tablekeep.operators.hashtree import TREE, bucket_of, different_buckets, leaves, levels, tree
from tablekeep.operators.sketches import SKETCH, sketches
from tablekeep.sources import files
from tablekeep.sources.small import small_frame

# Time formats that keep microseconds in text copies.
TEXT_TIMES = {
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "dateFormat": "yyyy-MM-dd",
}
FORMATS = {
    "parquet": {"write": {"compression": "zstd"}, "read": {}},
    "json": {
        "write": {"compression": "gzip", "ignoreNullFields": "false", **TEXT_TIMES},
        "read": {"mode": "FAILFAST", **TEXT_TIMES},
    },
}


DELTA = "delta"  # the format of copies that hold changes
SMALL_ROW = 64  # stored bytes, up to which a row takes no more than a few digests


def _fits_text(data_type: T.DataType) -> bool:
    """Whether JSON gives values of the type back as they were."""
    if isinstance(data_type, T.StructType):
        return all(_fits_text(f.dataType) for f in data_type.fields)
    if isinstance(data_type, T.ArrayType):
        return _fits_text(data_type.elementType)
    if isinstance(data_type, T.MapType):
        return isinstance(data_type.keyType, T.StringType) and _fits_text(data_type.valueType)
    return not isinstance(data_type, T.VariantType)


def write_copy(
    df: DataFrame,
    path: str,
    format: str = "parquet",
    compression: str | None = None,
    mode: str = "errorifexists",
    max_records_per_file: int = 0,
    buckets: int = 0,
    keys: Sequence[str] = (),
) -> dict:
    """Write a table and return its row_count and fingerprint.

    Both are observed while the rows stream into the writer, so the table is read
    once. The observation sits in the write's own stage, whose tasks count once
    even if they are run again. With ``buckets`` the copy is laid out by buckets of
    its keys (see ``operators.hashtree``), with the tree of their fingerprints
    beside it: what is made from the files read back, and so checks them. Each task
    sorts its own rows into the buckets, so a bucket has up to one file per task and
    no row is shuffled.
    """
    if buckets and format != "parquet":
        raise ValueError("only parquet copies have buckets")
    if format == "json" and not _fits_text(df.schema):
        raise ValueError("text copies hold no variants and only maps with string keys")
    options = {**FORMATS[format]["write"], "maxRecordsPerFile": str(max_records_per_file)}
    if compression:
        options["compression"] = compression
    seen, none = Observation(), {"row_count": 0, "fingerprint": Decimal(0)}
    own, name = free_name(df.columns, "hash64"), bucket_column(df.columns)
    if buckets:
        rows = df.withColumn(name, bucket_of(df, keys, buckets))
    else:
        rows = df
    watched = rows.withColumn(own, row_hash(df.schema)).observe(seen, *fingerprint_parts(F.col(own)))
    writer = watched.drop(own).write.format(format).options(**options).mode(mode)
    if not buckets:
        writer.save(path)
        return {**none, **seen.get}  # nothing is seen of no rows
    writer.partitionBy(name).save(path)
    written = {**none, **seen.get}
    _write_tree(df.sparkSession, path, df.schema, buckets, list(keys), written)
    return written


def bucket_column(names: Iterable[str]) -> str:
    """The column that says a row's bucket: ``bucket`` unless the table has one."""
    low, name = {n.lower() for n in names}, "bucket"
    while name in low:
        name += "_"
    return name


def _write_tree(
    spark: SparkSession, path: str, schema: T.StructType, buckets: int, keys: list[str], written: dict
) -> None:
    stored = tree(leaves(read_buckets(spark, path, schema), bucket_column(schema.names)), buckets)
    stored.coalesce(1).sortWithinPartitions("level", "node").write.parquet(f"{path}/_tree")
    root = read_tree(spark, path).where(F.col("level") == levels(buckets)).first()
    found = {k: root[k] for k in written} if root else {"row_count": 0, "fingerprint": Decimal(0)}
    if found != written:
        raise ValueError(f"{path} holds {found}, written were {written}")
    files.write_new(spark, f"{path}/_tree.json", json.dumps({"buckets": buckets, "keys": keys}).encode())


def read_buckets(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A copy laid out by buckets, with their column; conditions on it choose folders."""
    with_bucket = T.StructType([*schema.fields, T.StructField(bucket_column(schema.names), T.IntegerType())])
    return spark.read.schema(with_bucket).parquet(path)


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TREE).parquet(f"{path}/_tree")


def tree_layout(spark: SparkSession, path: str) -> dict | None:
    """``buckets`` and ``keys`` of a copy that has a tree."""
    if not files.exists(spark, f"{path}/_tree.json"):
        return None
    return json.loads(files.read_bytes(spark, f"{path}/_tree.json"))


def changed_buckets(spark: SparkSession, old_path: str, new_path: str) -> list[int]:
    """The buckets in which two copies of a table differ, from their trees alone."""
    layout = tree_layout(spark, new_path)
    if layout is None or layout != tree_layout(spark, old_path):
        raise ValueError("both copies need a tree of the same buckets and keys")
    return different_buckets(read_tree(spark, old_path), read_tree(spark, new_path), layout["buckets"])


def differing_parts(
    spark: SparkSession, old_path: str, new_path: str, schema: T.StructType
) -> tuple[DataFrame, DataFrame]:
    """What two copies of one schema hold in the buckets in which they differ; no other is read."""
    chosen = changed_buckets(spark, old_path, new_path)
    name = bucket_column(schema.names)
    old, new = (
        read_buckets(spark, path, schema).where(F.col(name).isin(chosen)).drop(name)
        for path in (old_path, new_path)
    )
    return old, new


def copy_delta(spark: SparkSession, old_path: str, new_path: str, schema: T.StructType) -> DataFrame:
    """:func:`row_delta` of two copies, which reads and shuffles differing buckets only.

    Small rows are compared by content, which shuffles each once: where many changed, digests would be
    shuffled beside them. Large ones are compared by digests, so that only changed ones need be moved.
    """
    small = _row_bytes(spark, new_path) <= SMALL_ROW
    parts = differing_parts(spark, old_path, new_path, schema)
    return row_delta(*parts, "content" if small else "digest")


def _row_bytes(spark: SparkSession, path: str) -> float:
    """The stored bytes per row of a copy that has a tree."""
    rows = read_tree(spark, path).agg(F.max("row_count")).first()[0]  # the root has them all
    return files.size_bytes(spark, path) / max(rows or 0, 1)


def small_rows(spark: SparkSession, path: str, row_count: int) -> bool:
    """Whether a whole copy stores so few bytes a row that rows had better be moved than digests of them."""
    return files.size_bytes(spark, path) <= SMALL_ROW * max(row_count, 1)


def schema_of(schema_json: str) -> T.StructType:
    """The schema a manifest row holds."""
    return T.StructType.fromJson(json.loads(schema_json))


def read_copy(
    spark: SparkSession, path: str, format: str, schema_json: str, chain: Sequence[str] | None = None
) -> DataFrame:
    """A copy with the schema it was written with; a delta is folded into what it is built on."""
    base, deltas = read_chain(spark, path, format, schema_json, chain)
    return folded(base, deltas)


def read_chain(
    spark: SparkSession, path: str, format: str, schema_json: str, chain: Sequence[str] | None = None
) -> tuple[DataFrame, list[DataFrame]]:
    """The whole copy that a copy is or is built on, and the deltas to be folded into it."""
    schema = schema_of(schema_json)
    if format == DELTA:
        base, *before = chain
        deltas = [spark.read.schema(delta_schema(schema)).parquet(p) for p in (*before, path)]
        return read_chain(spark, base, "parquet", schema_json)[0], deltas
    reader = spark.read.format(format).options(**FORMATS[format]["read"])
    reader = reader.option("recursiveFileLookup", "true")  # buckets are no column
    return reader.schema(schema).load(path), []


def write_sketches(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Keep the sketches of a copy's rows beside it."""
    sketches(rows).coalesce(1).write.parquet(f"{path}/_sketches")


def copy_sketches(spark: SparkSession, copies: DataFrame) -> DataFrame:
    """The sketches kept with some copies, given as manifest rows, and whose they are; no data is read."""
    rows = copies.select("schema_name", "table_name", "path").collect()
    places = [f"{r['path']}/_sketches" for r in rows]
    if not places:
        raise LookupError("no copies are given")
    at = small_frame(
        spark, [(p, r["schema_name"], r["table_name"]) for p, r in zip(places, rows)],
        "place string, schema_name string, table_name string",
    )
    found = spark.read.schema(SKETCH).parquet(*places)
    # file paths are shown as URIs, in which a plus sign stands for itself
    file = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    place = F.regexp_replace(file, "/[^/]*$", "")
    found = found.withColumn("place", F.regexp_replace(place, "^file:/+", "/"))
    at = at.withColumn("place", F.regexp_replace("place", "^file:/+", "/"))
    return found.join(at, "place").drop("place")


def write_delta(
    old: DataFrame, new: DataFrame, path: str, deltas: Sequence[DataFrame] = (), small: bool = False
) -> dict:
    """Write what changed between two versions of a table, the old one given by a copy and its deltas.

    Small rows are compared by content, as in :func:`copy_delta`: each version is read and shuffled once.
    Returns the ``rows`` written, and what they add to the table's row_count and fingerprint.
    """
    seen, delta = Observation(), signed_delta(old, new, deltas, "content" if small else "digest")
    copies, own = delta.columns[-1], free_name(delta.columns, "hash64")
    hashed = delta.withColumn(own, row_hash(old.schema).cast("decimal(28,0)"))
    watched = hashed.observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(copies), F.lit(0)).alias("row_count"),
        F.sum(F.col(own) * F.col(copies).cast("decimal(10,0)")).cast("decimal(38,0)").alias("fingerprint"),
    )
    watched.drop(own).write.options(**FORMATS["parquet"]["write"]).parquet(path)
    found = {"rows": 0, "row_count": 0, "fingerprint": None, **seen.get}
    return {**found, "fingerprint": found["fingerprint"] or Decimal(0)}


def measure(df: DataFrame) -> dict:
    """row_count and fingerprint of a table as it is now, in one pass."""
    hashed = df.select(row_hash(df.schema).alias("hash64"))
    return hashed.agg(*fingerprint_parts(F.col("hash64"))).first().asDict()


def same_shape(left: T.StructType, right: T.StructType) -> bool:
    """Same column names and types; whether NULL is allowed does not matter."""
    return _plain(left) == _plain(right)


def _plain(data_type: T.DataType):
    if isinstance(data_type, T.StructType):
        return ("struct", [(f.name, _plain(f.dataType)) for f in data_type.fields])
    if isinstance(data_type, T.ArrayType):
        return ("array", _plain(data_type.elementType))
    if isinstance(data_type, T.MapType):
        return ("map", _plain(data_type.keyType), _plain(data_type.valueType))
    return data_type.simpleString()


