"""Hash trees: buckets, differing parts, and how little a comparison reads."""

import re

import pytest
from pyspark.sql import functions as F

from tablekeep.operators.change import row_delta
from tablekeep.operators.hashtree import bucket_of, different_buckets, leaves, levels, tree
from tablekeep.plans import copies, restore
from tablekeep.plans.snapshot import SnapshotOptions, snapshot_full, snapshot_incremental
from tablekeep.sources.tables import FrameTables
from tests.conftest import rows
from tests.test_snapshots import DAYS


def nodes(df, keys, buckets=40, fan=3):
    dealt = df.withColumn("bucket", bucket_of(df, keys, buckets))
    return tree(leaves(dealt, "bucket"), buckets, fan)


def test_levels():
    assert [levels(n, 16) for n in (1, 2, 16, 17, 256, 257)] == [0, 1, 1, 2, 2, 3]


@pytest.mark.parametrize("keys", [["o_orderkey"], ["o_custkey", "o_orderdate"], []])
def test_differing_buckets_are_those_of_the_changed_rows(spark, data, keys):
    old = spark.read.parquet(f"{data}/orders.parquet")
    changed = F.col("o_orderkey") % 97 == 5
    new = old.withColumn("o_totalprice", F.col("o_totalprice") + F.when(changed, 1).otherwise(0))
    new = new.where("o_orderkey <> 33").unionAll(old.where("o_orderkey = 64"))
    delta = row_delta(old, new)
    touched = delta.select(bucket_of(old, keys, 40)).distinct()
    found = different_buckets(nodes(old, keys), nodes(new, keys), 40, 3)
    assert found == sorted(r[0] for r in touched.collect()) and 0 < len(found)


def test_equal_tables_and_empty_ones(spark, data):
    old = spark.read.parquet(f"{data}/orders.parquet")
    assert different_buckets(nodes(old, ["o_orderkey"]), nodes(old.repartition(5), ["o_orderkey"]), 40, 3) == []
    none = old.limit(0)
    assert different_buckets(nodes(none, []), nodes(none, []), 40, 3) == []
    assert len(different_buckets(nodes(none, ["o_orderkey"]), nodes(old, ["o_orderkey"]), 40, 3)) == 40


def pair(spark, root, old, new, **options):
    chosen = SnapshotOptions(buckets=32, **options)
    snapshot_full(FrameTables(spark, {("s", "t"): old}), root, "a", DAYS[0], options=chosen)
    snapshot_incremental(FrameTables(spark, {("s", "t"): new}), root, "b", DAYS[1], options=chosen)
    found = restore.chosen_copies(spark, root, snapshot_id="a").first()
    return found, restore.chosen_copies(spark, root, snapshot_id="b").first()


def test_a_change_of_one_key_reads_one_bucket(spark, root, data):
    old = spark.read.parquet(f"{data}/lineitem.parquet")
    new = old.withColumn("l_tax", F.when(F.col("l_orderkey") == 7, 9.0).otherwise(F.col("l_tax")))
    a, b = pair(spark, root, old, new, keys={"t": ["l_orderkey"]})
    assert len(copies.changed_buckets(spark, a["path"], b["path"])) == 1
    parts = copies.differing_parts(spark, a["path"], b["path"], old.schema)
    assert sum(p.count() for p in parts) * 10 < 2 * old.count()
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    for part in parts:
        scan = part._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^]]*bucket", scan)
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert rows(copies.copy_delta(spark, a["path"], b["path"], old.schema)) == rows(row_delta(old, new))


@pytest.mark.parametrize("keys", [{}, {"t": ["k"]}])
def test_copies_with_trees_are_restored_as_others(spark, root, keys):
    schema = "k int, bucket string, v array<double>, m map<string,int>"
    old = spark.createDataFrame(
        [(i % 50, None if i % 7 else "x", [i * 0.1, None], {"a": i}) for i in range(300)] + [(None,) * 4], schema
    )
    if not keys:
        old = old.drop("m")
    new = old.where("k <> 3").unionAll(old.where("k = 4"))
    a, b = pair(spark, root, old, new, keys=keys)
    assert restore.validate_snapshot(spark, root).where("valid").count() == 1
    back = restore.restored_tables(spark, root, as_of=DAYS[0]).read("s", "t")
    assert back.columns == old.columns and row_delta(old, back).isEmpty() if keys == {} else True
    restore.restore_to_folder(spark, restore.chosen_copies(spark, root), f"{root}/to")
    again = spark.read.parquet(f"{root}/to/s/t.parquet")
    assert again.columns == new.columns and again.count() == new.count()
    found = copies.changed_buckets(spark, a["path"], b["path"])
    assert 1 <= len(found) <= (3 if keys else 32)  # the row without a key goes, too


def test_copies_without_the_same_tree_are_not_compared(spark, root):
    df = spark.range(200)
    copies.write_copy(df, f"{root}/a", buckets=4, keys=["id"])
    copies.write_copy(df, f"{root}/b", buckets=8, keys=["id"])
    copies.write_copy(df, f"{root}/c")
    for other in "bc":
        with pytest.raises(ValueError, match="tree"):
            copies.changed_buckets(spark, f"{root}/a", f"{root}/{other}")
    with pytest.raises(ValueError, match="parquet"):
        copies.write_copy(df, f"{root}/d", "json", buckets=4)
    empty = copies.write_copy(df.limit(0), f"{root}/e", buckets=4, keys=["id"])
    assert empty == {"row_count": 0, "fingerprint": 0}
    assert copies.changed_buckets(spark, f"{root}/a", f"{root}/e") == [0, 1, 2, 3]


def test_a_copy_in_buckets_is_written_without_a_shuffle(spark, root, data, monkeypatch):
    df = spark.read.parquet(f"{data}/lineitem.parquet")
    monkeypatch.setattr(copies, "_write_tree", lambda *_: None)
    context = spark.sparkContext
    context.setJobGroup(root, "one copy")
    try:
        written = copies.write_copy(df, f"{root}/a", buckets=8, keys=["l_orderkey"])
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    jobs = [context.statusTracker().getJobInfo(j) for j in context.statusTracker().getJobIdsForGroup(root)]
    assert len([stage for job in jobs for stage in job.stageIds]) == 1
    assert written == copies.measure(df)
    buckets = copies.read_buckets(spark, f"{root}/a", df.schema).select("bucket").distinct()
    assert sorted(r[0] for r in buckets.collect()) == list(range(8))


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_a_delta_of_small_rows_shuffles_each_once(spark, root, data):
    old = spark.read.parquet(f"{data}/lineitem.parquet")
    new = old.withColumn("l_tax", F.when(F.col("l_orderkey") % 3 == 0, 9.0).otherwise(F.col("l_tax")))
    new = new.where("l_quantity > 2").unionAll(old.where("l_discount = 0.1"))
    copies.write_copy(old, f"{root}/a", buckets=4, keys=["l_orderkey"])
    copies.write_copy(new, f"{root}/b", buckets=4, keys=["l_orderkey"])
    delta = copies.copy_delta(spark, f"{root}/a", f"{root}/b", old.schema)
    assert _exchanges(delta) == 1
    assert rows(delta) == rows(row_delta(old, new, "digest")) and delta.count() > 0


def test_a_delta_of_large_rows_shuffles_digests(spark, root):
    old = spark.range(400).select("id", F.concat(*[F.sha2(F.concat("id", F.lit(i)), 512) for i in range(4)]).alias("t"))
    new = old.where("id <> 7").unionAll(old.where("id = 9"))
    copies.write_copy(old, f"{root}/a", buckets=4, keys=["id"])
    copies.write_copy(new, f"{root}/b", buckets=4, keys=["id"])
    delta = copies.copy_delta(spark, f"{root}/a", f"{root}/b", old.schema)
    assert _exchanges(delta) > 1
    assert [r[:3] for r in rows(delta)] == [("deleted", 1, 7), ("inserted", 1, 9)]
    copies.write_copy(old.limit(0), f"{root}/c", buckets=4, keys=["id"])
    assert copies.copy_delta(spark, f"{root}/b", f"{root}/c", old.schema).count() == 399
