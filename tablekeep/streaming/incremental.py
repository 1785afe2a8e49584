"""Taking over new files only, each batch once, with a checkpoint as the high-water mark."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tablekeep.plans.copies import schema_of, write_copy
from tablekeep.plans.manifest import append_manifest, copy_folder, new_run_id, read_manifest
from tablekeep.sources import files


def new_files(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    pattern: str = "*.parquet",
    max_files_per_batch: int = 1000,
) -> DataFrame:
    """A stream of the rows of files not seen before."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", str(max_files_per_batch))
        .parquet(folder)
    )


def _batch_id(checkpoint: str, batch: int) -> str:
    """The key of a batch: its number and the stream's, which lives as long as the checkpoint."""
    return f"stream-{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}#{batch:012d}"


def append_batches(
    stream: DataFrame, root: str, schema_name: str, table_name: str, checkpoint: str
) -> int:
    """Append all rows there are now to a table below a snapshot root, then stop; returns how many.

    A batch is a folder and one row of the manifest, whose id is the batch's number in the
    checkpoint. The row is what makes the batch count: data of a batch that died before it is never
    read, and goes when its age is that of what rotation removes. A batch that had its row and is run
    again, because the stream died before its own checkpoint, adds nothing. Rows are counted while
    they are written; the table itself is never read.
    """
    spark, root, total = stream.sparkSession, root.rstrip("/"), 0
    checkpoint = files.full_path(spark, checkpoint.rstrip("/"))
    first = True

    def append(batch: DataFrame, number: int) -> None:
        nonlocal total, first
        key, again, first = _batch_id(checkpoint, number), first, False
        # only the first batch of a run can be one that an earlier run has ended
        if again and not _batches(spark, root, schema_name, table_name).where(F.col("snapshot_id") == key).isEmpty():
            return
        run_id = new_run_id()
        path = copy_folder(root, schema_name, table_name, key, run_id)
        written = write_copy(batch, path)
        row = {
            "snapshot_id": key,
            "run_id": run_id,
            "kind": "batch",
            "run_kind": "stream",
            "schema_name": schema_name,
            "table_name": table_name,
            "path": path,
            "format": "parquet",
            "schema_json": batch.schema.json(),
            "size_bytes": files.size_bytes(spark, path),
            "status": "appended",
            **written,
        }
        append_manifest(spark, root, [row])
        total += written["row_count"]

    query = (
        stream.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return total


def _batches(spark: SparkSession, root: str, schema_name: str, table_name: str) -> DataFrame:
    rows = read_manifest(spark, root).where("status = 'appended'")
    return rows.where((F.col("schema_name") == schema_name) & (F.col("table_name") == table_name))


def appended_table(spark: SparkSession, root: str, schema_name: str, table_name: str) -> DataFrame:
    """The rows of all batches of a table, with the columns of the newest batch."""
    found = _batches(spark, root.rstrip("/"), schema_name, table_name)
    rows = sorted(found.select("run_id", "path", "schema_json").collect())
    if not rows:
        raise LookupError(f"nothing was appended to {schema_name}.{table_name} in {root}")
    schema = schema_of(rows[-1]["schema_json"])
    return spark.read.schema(schema).parquet(*[r["path"] for r in rows])


def appended_rows(spark: SparkSession, root: str) -> DataFrame:
    """Batches and rows of every table that streams were appended to, from the manifest alone."""
    rows = read_manifest(spark, root.rstrip("/")).where("status = 'appended'")
    return rows.groupBy("schema_name", "table_name").agg(
        F.count(F.lit(1)).alias("batches"), F.sum("row_count").alias("row_count")
    )
