"""Streams of files into a snapshot root: new rows only, each batch once."""

from datetime import datetime

import pytest

from tablekeep.plans import rotation
from tablekeep.plans.manifest import read_log
from tablekeep.sources import files
from tablekeep.streaming import incremental
from tablekeep.streaming.incremental import append_batches, appended_rows, appended_table, new_files


def arrive(spark, root, name, start, count):
    spark.range(start, start + count).coalesce(1).write.parquet(f"{root}/in/{name}")


def take_over(spark, root, per_batch=1000):
    schema = spark.range(1).schema
    stream = new_files(spark, f"{root}/in/*", schema, max_files_per_batch=per_batch)
    return append_batches(stream, root, "s", "t", f"{root}/checkpoint")


def ids(spark, root):
    return sorted(r[0] for r in appended_table(spark, root, "s", "t").collect())


def test_only_new_rows_are_added(spark, root):
    arrive(spark, root, "a", 0, 10)
    assert take_over(spark, root) == 10
    assert take_over(spark, root) == 0
    arrive(spark, root, "b", 10, 5)
    assert take_over(spark, root) == 5
    assert ids(spark, root) == list(range(15))
    assert appended_rows(spark, root).first()[:] == ("s", "t", 2, 15)


def test_more_batches_than_the_query_remembers(spark, root):
    for i in range(12):
        arrive(spark, root, f"f{i}", 10 * i, 10)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    assert take_over(spark, root, 1) == 120
    spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert ids(spark, root) == list(range(120))


def test_the_target_is_never_read(spark, root, monkeypatch):
    arrive(spark, root, "a", 0, 10)
    take_over(spark, root)
    for (path,) in read_log(spark, root).where("path <> ''").select("path").collect():
        files.delete(spark, path)
    arrive(spark, root, "b", 10, 5)
    assert take_over(spark, root) == 5


def test_a_batch_run_again_adds_nothing(spark, root):
    for i in range(3):
        arrive(spark, root, f"f{i}", 10 * i, 10)
    assert take_over(spark, root, 1) == 30
    assert files.delete(spark, f"{root}/checkpoint/commits/2")
    arrive(spark, root, "later", 30, 10)
    assert take_over(spark, root, 1) == 10
    assert ids(spark, root) == list(range(40))


def test_a_batch_that_died_before_its_row_counts_once(spark, root, monkeypatch):
    arrive(spark, root, "a", 0, 10)
    with monkeypatch.context() as patch:
        patch.setattr(incremental, "append_manifest", lambda *args: 1 / 0)
        with pytest.raises(Exception):
            take_over(spark, root)
    with pytest.raises(LookupError):
        appended_table(spark, root, "s", "t")
    assert take_over(spark, root) == 10
    assert ids(spark, root) == list(range(10))
    left = files.children(spark, f"{root}/tables/s/t")
    assert len(left) == 2  # one is of the batch that died
    rotation.retention_apply(spark, root, datetime(2100, 1, 1), 30)
    assert len(files.children(spark, f"{root}/tables/s/t")) == 1
    assert ids(spark, root) == list(range(10))
