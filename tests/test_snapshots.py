from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tablekeep.operators.catalogue import (
    from_manifest,
    latest_per_table,
    restore_chain,
    restore_points,
)
from tablekeep.operators.change import changed_tables, row_delta
from tablekeep.operators.selection import select_tables
from tablekeep.plans import restore, rotation
from tablekeep.plans.jobs import run_jobs
from tablekeep.plans.manifest import append_removed, copies_as_of, read_manifest
from tablekeep.plans.rotation import retention_apply
from tablekeep.plans.snapshot import (
    NoBaseError,
    SnapshotError,
    SnapshotOptions,
    snapshot_full,
    snapshot_incremental,
    snapshot_schemas,
    table_measures,
)
from tablekeep.sources import files
from tablekeep.sources.tables import CatalogTables, FrameTables, JdbcTables, ParquetTables
from tests.conftest import rows

DAYS = [datetime(2024, 1, d) for d in range(1, 10)]


def frames(spark, **tables):
    """Source with schema ``s``: name -> list of values."""
    made = {
        ("s", name): spark.createDataFrame([(v,) for v in values], "v int")
        for name, values in tables.items()
    }
    return FrameTables(spark, made)


def values(source, name, schema="s"):
    return sorted(r[0] for r in source.read(schema, name).collect())


def paths(df):
    return sorted(r["path"] for r in df.collect())


def report(df):
    return {r["table_name"]: (r["change"], r["row_count"], r["status"]) for r in df.collect()}


# round trips


@pytest.mark.parametrize("format", ["parquet", "json"])
def test_every_table_survives(spark, root, data, format):
    source = ParquetTables(spark, data)
    snapshot_full(source, root, "one", DAYS[0], options=SnapshotOptions(format=format))
    back = restore.restored_tables(spark, root)
    assert rows(back.tables()) == rows(source.tables())
    for schema, name in source.tables().collect():
        old, new = source.read(schema, name), back.read(schema, name)
        assert old.schema == new.schema
        assert old.exceptAll(new).isEmpty() and new.exceptAll(old).isEmpty()


@pytest.mark.parametrize("format", ["parquet", "json"])
def test_awkward_values_survive(spark, root, format):
    df = spark.sql(
        r"""
        SELECT * FROM VALUES
          (1, '', TIMESTAMP_NTZ'2024-01-01 00:00:00.000001', array('a', NULL, ''), DATE'1900-01-01'),
          (2, NULL, TIMESTAMP_NTZ'1999-12-31 23:59:59.999999', NULL, NULL),
          (3, '\\N', NULL, array(), DATE'9999-12-31'),
          (4, 'a\nb"c,\t\r\n', TIMESTAMP_NTZ'2024-01-01 00:00:00', array(NULL), NULL)
        AS t(i, v, ts, a, d)
        """
    ).select(
        "*",
        F.lit(b"\x00\xff").alias("bin"),
        F.lit("1.10").cast("decimal(20,2)").alias("dec"),
        F.col("ts").cast("timestamp").alias("tz"),
        F.create_map(F.lit("k"), F.col("v")).alias("m"),
        F.struct("i", "v").alias("st"),
        F.lit(float("nan")).alias("nan"),
        F.lit(True).alias("yes"),
    )
    options = SnapshotOptions(format=format)
    snapshot_full(FrameTables(spark, {("s", "t"): df}), root, "one", DAYS[0], options=options)
    back = restore.restored_tables(spark, root).read("s", "t")
    assert rows(back.withColumn("nan", F.isnan("nan"))) == rows(df.withColumn("nan", F.isnan("nan")))
    assert restore.validate_snapshot(spark, root).first()["valid"]


@pytest.mark.parametrize("format", ["parquet", "json"])
def test_odd_columns_survive(spark, root, format):
    names = ["a.b", "c d", "e`f", 'g"h', "é", "x,;{}()=", "UPPER", "new\tline"]
    df = spark.range(3).select(
        *[(F.col("id") + i).alias(n) for i, n in enumerate(names)],
        F.struct(F.col("id").alias("x.y"), F.lit(None).cast("int").alias("z")).alias("s.t"),
        F.array(F.struct(F.lit(1).alias("q r"))).alias("list"),
        F.lit(float("inf")).alias("inf"),
        F.lit(-0.0).alias("zero"),
        F.col("id").cast("decimal(38,18)").alias("dec"),
        F.expr("CAST(1.5 AS FLOAT)").alias("f"),
        F.expr("CAST(3 AS TINYINT)").alias("tiny"),
    )
    options = SnapshotOptions(format=format)
    source = FrameTables(spark, {("s", "t"): df})
    snapshot_full(source, root, "one", DAYS[0], options=options)
    back = restore.restored_tables(spark, root).read("s", "t")
    assert back.columns == df.columns
    assert rows(back) == rows(df)
    assert restore.validate_snapshot(spark, root).first()["valid"]
    assert report(snapshot_incremental(source, root, "two", DAYS[1]))["t"][0] == "unchanged"


@pytest.mark.parametrize("value", ["map(1, 'x')", "array(parse_json('1'))", "array(map(1, 2))"])
def test_text_refuses_what_it_would_not_give_back(spark, root, value):
    source = FrameTables(spark, {("s", "t"): spark.sql(f"SELECT {value} AS v")})
    with pytest.raises(SnapshotError):
        snapshot_full(source, root, "text", DAYS[0], options=SnapshotOptions(format="json"))
    snapshot_full(source, root, "columns", DAYS[1], options=SnapshotOptions(verify=True))
    assert read_manifest(spark, root).where("status = 'ok'").count() == 1


# manifest


def test_manifest_names_what_was_written(spark, root, data):
    source = ParquetTables(spark, data)
    chosen = select_tables(source.tables(), only="orders,region")
    snapshot_full(source, root, "one", DAYS[0], chosen)
    manifest = {r["table_name"]: r for r in read_manifest(spark, root).collect()}
    assert set(manifest) == {"orders", "region"}
    row = manifest["orders"]
    assert (row["snapshot_id"], row["kind"], row["status"]) == ("one", "full", "ok")
    assert row["created_at"] == DAYS[0] and row["row_count"] == 1500 and row["size_bytes"] > 0
    assert spark.read.parquet(row["path"]).count() == 1500


def test_same_id_again_replaces_table_by_table(spark, root):
    snapshot_full(frames(spark, a=[1], b=[1]), root, "one", DAYS[0])
    snapshot_full(frames(spark, a=[1, 2]), root, "one", DAYS[1])
    found = read_manifest(spark, root).collect()
    assert sorted((r["table_name"], r["row_count"]) for r in found) == [("a", 2), ("b", 1)]


def test_two_schemas_under_one_id(spark, root):
    sales, corpus = frames(spark, a=[1]), FrameTables(spark, {("t", "b"): spark.range(3)})
    both = FrameTables(spark, {**sales.frames, **corpus.frames})
    snapshot_schemas(both, root, "s", "one", DAYS[0])
    snapshot_schemas(both, root, "t", "one", DAYS[0])
    found = {(r["schema_name"], r["table_name"]) for r in read_manifest(spark, root).collect()}
    assert found == {("s", "a"), ("t", "b")}


def test_failed_rerun_loses_nothing(spark, root):
    snapshot_full(frames(spark, good=[1, 2], other=[3], bad=[9]), root, "one", DAYS[0])
    with pytest.raises(SnapshotError):
        snapshot_full(broken(spark), root, "one", DAYS[1])
    assert values(restore.restored_tables(spark, root), "bad") == [9]
    retention_apply(spark, root, datetime(2030, 1, 1), 30)
    back = restore.restored_tables(spark, root)
    assert (values(back, "bad"), values(back, "good")) == ([9], [1, 2])


def test_retry_of_an_incremental_run(spark, root):
    snapshot_full(frames(spark, good=[1], other=[3], bad=[9]), root, "full", DAYS[0])
    with pytest.raises(SnapshotError):
        snapshot_incremental(broken(spark), root, "inc", DAYS[1])
    snapshot_incremental(frames(spark, good=[1, 2], other=[3], bad=[9, 10]), root, "inc", DAYS[1])
    back = restore.restored_tables(spark, root)
    assert (values(back, "good"), values(back, "bad")) == ([1, 2], [9, 10])


def test_an_id_is_for_one_kind_of_run(spark, root):
    snapshot_full(frames(spark, a=[1]), root, "one", DAYS[0])
    with pytest.raises(ValueError, match="another kind"):
        snapshot_incremental(frames(spark, a=[1, 2]), root, "one", DAYS[1])
    snapshot_incremental(frames(spark, a=[1, 2]), root, "two", DAYS[1])
    with pytest.raises(ValueError, match="another kind"):
        snapshot_full(frames(spark, a=[1]), root, "two", DAYS[2])
    assert values(restore.restored_tables(spark, root), "a") == [1, 2]


def test_a_dead_run_is_taken_up(spark, root):
    """A run that ended after one of two tables: its rerun keeps that one and writes the other."""
    with pytest.raises(SnapshotError):
        snapshot_full(broken(spark), root, "one", DAYS[0])
    first = {r["table_name"]: r["path"] for r in read_manifest(spark, root).collect()}
    snapshot_full(frames(spark, good=[7, 7], other=[3], bad=[9]), root, "one", DAYS[0])
    found = {r["table_name"]: r for r in read_manifest(spark, root).collect()}
    assert {n: r["status"] for n, r in found.items()} == {"good": "ok", "other": "ok", "bad": "ok"}
    assert found["good"]["path"] == first["good"] and found["bad"]["path"] != first["bad"]
    snapshot_full(frames(spark, good=[7, 7]), root, "one", DAYS[0])  # closed now: copied anew
    assert values(restore.restored_tables(spark, root), "good") == [7, 7]


def test_two_copies_of_one_time(spark, root):
    snapshot_full(frames(spark, a=[1]), root, "z", DAYS[0])
    snapshot_full(frames(spark, a=[1, 2]), root, "b", DAYS[0])
    assert values(restore.restored_tables(spark, root), "a") == [1, 2]
    retention_apply(spark, root, datetime(2030, 1, 1), 30)
    assert values(restore.restored_tables(spark, root), "a") == [1, 2]


def test_rotation_clears_orphans_and_tries_again(spark, root):
    snapshot_full(frames(spark, a=[1]), root, "one", DAYS[0])
    orphan = f"{root}/tables/s/a/lost-20240101000000000000-0123abcd"
    young = f"{root}/tables/s/a/now-20291231000000000000-0123abcd"
    for path in (orphan, young):
        spark.range(1).write.parquet(path)
    assert paths(retention_apply(spark, root, datetime(2030, 1, 1), 30)) == [orphan]
    assert not files.exists(spark, orphan) and files.exists(spark, young)
    kept = f"{root}/tables/s/a/kept"
    spark.range(1).write.parquet(kept)
    append_removed(spark, root, [{"path": kept, "removed_at": DAYS[0], "deleted": False}])
    retention_apply(spark, root, datetime(2030, 1, 1), 30)
    assert not files.exists(spark, kept)


def test_tables_that_are_gone_are_no_restore_points(spark, root):
    snapshot_full(frames(spark, a=[1], b=[1]), root, "mon", DAYS[0])
    snapshot_incremental(frames(spark, a=[1]), root, "tue", DAYS[1])
    known = from_manifest(read_manifest(spark, root))
    late = "2030-01-01 00:00:00"
    assert [r["table_name"] for r in restore_points(known, late, "run_id").collect()] == ["s.a"]
    assert {r["table_name"] for r in restore_chain(known, late, "run_id").collect()} == {"s.a"}
    assert [r["table_name"] for r in latest_per_table(known, "run_id").collect()] == ["s.a"]
    assert {r["table_name"] for r in restore_points(known, DAYS[0], "run_id").collect()} == {"s.a", "s.b"}


def test_renamed_columns_are_a_change(spark):
    old = FrameTables(spark, {("s", "t"): spark.range(5)})
    new = FrameTables(spark, {("s", "t"): spark.range(5).toDF("other")})
    found = changed_tables(table_measures(new), table_measures(old)).first()
    assert found["change"] == "changed"


def test_columns_of_all_files(spark, root):
    spark.range(3).write.parquet(f"{root}/in/t.parquet")
    spark.range(2).selectExpr("id", "id * 2 AS more").write.mode("append").parquet(f"{root}/in/t.parquet")
    snapshot_full(ParquetTables(spark, f"{root}/in", "s"), f"{root}/out", "one", DAYS[0])
    back = restore.restored_tables(spark, f"{root}/out").read("s", "t")
    assert back.columns == ["id", "more"] and back.where("more IS NOT NULL").count() == 2


def test_odd_column_names_survive(spark, root):
    df = spark.createDataFrame([(1, 2, 3)], "__hash64 int, __net int, __sign int")
    snapshot_full(FrameTables(spark, {("s", "t"): df}), root, "one", DAYS[0])
    assert rows(restore.restored_tables(spark, root).read("s", "t")) == [(1, 2, 3)]
    assert row_delta(df, df.limit(0)).columns == ["change", "copies", *df.columns]


def test_append_refuses_other_columns(spark, root):
    snapshot_full(frames(spark, a=[1]), f"{root}/r", "one", DAYS[0])
    copies = restore.chosen_copies(spark, f"{root}/r")
    spark.range(2).toDF("q").write.parquet(f"{root}/to/s/a.parquet")
    with pytest.raises(restore.TargetExistsError, match="other columns"):
        restore.restore_to_folder(spark, copies, f"{root}/to", "append")
    assert spark.read.parquet(f"{root}/to/s/a.parquet").columns == ["q"]


def test_managed_tables_are_not_replaced(spark, root):
    snapshot_full(FrameTables(spark, {("s", "m"): spark.range(4)}), root, "one", DAYS[0])
    copies = restore.chosen_copies(spark, root)
    spark.sql("CREATE DATABASE IF NOT EXISTS managed_db")
    spark.sql("DROP TABLE IF EXISTS managed_db.m")
    spark.range(2).write.saveAsTable("managed_db.m")
    with pytest.raises(restore.TargetExistsError, match="managed"):
        restore.restore_to_catalog(spark, copies, f"{root}/c", "force", database="managed_db")
    assert spark.table("managed_db.m").count() == 2
    spark.sql("DROP TABLE managed_db.m")
    restore.restore_to_catalog(spark, copies, f"{root}/c", "force", database="managed_db")
    restore.restore_to_catalog(spark, copies, f"{root}/c", "force", database="managed_db")
    assert spark.table("managed_db.m").count() == 4


def test_slashes_in_names_are_restored(spark, root):
    snapshot_full(FrameTables(spark, {("s", "a/b"): spark.range(4)}), root, "one", DAYS[0])
    restore.restore_to_folder(spark, restore.chosen_copies(spark, root), f"{root}/to")
    assert spark.read.parquet(f"{root}/to/s/a%2Fb.parquet").count() == 4


def test_unchanged_catalog_tables_are_not_read(spark, root):
    spark.sql("CREATE DATABASE IF NOT EXISTS states_db")
    spark.sql("DROP TABLE IF EXISTS states_db.t")
    spark.range(10).write.saveAsTable("states_db.t")
    source = CatalogTables(spark, ["states_db"])
    snapshot_full(source, root, "one", DAYS[0])
    source.cheap_count = None  # a look at the rows would need this
    found = report(snapshot_incremental(source, root, "two", DAYS[1]))
    assert found["t"][2] == "unchanged"
    assert source.states([("states_db", "t")])
    spark.range(1).write.mode("append").saveAsTable("states_db.t")
    assert report(snapshot_incremental(source, root, "three", DAYS[2]))["t"][2] == "ok"


def test_an_id_is_made_from_the_time(spark, root):
    snapshot_full(frames(spark, a=[1]), root, at=datetime(2024, 3, 15, 12))
    assert read_manifest(spark, root).first()["snapshot_id"] == "20240315_120000_000000"


def test_odd_names(spark, root):
    df = spark.range(3)
    odd = {("my schema", "a/b*[c]{d}?"): df, ("s", "50% off"): df, ("s", "ü:x"): df}
    snapshot_full(FrameTables(spark, odd), root, "2024-01-01T00:00:00", DAYS[0])
    back = restore.restored_tables(spark, root, snapshot_id="2024-01-01T00:00:00")
    assert set(back.frames) == set(odd)
    assert all(f.count() == 3 for f in back.frames.values())
    assert restore.validate_snapshot(spark, root).where("valid").count() == 3


def test_no_manifest_yet(spark, root):
    assert read_manifest(spark, root).isEmpty()
    with pytest.raises(LookupError):
        restore.restored_tables(spark, root)


def broken(spark):
    source = frames(spark, good=[1, 2], other=[3])
    bad = source.frames["s", "good"].select(F.raise_error(F.lit("broken disk")).alias("v"))
    source.frames["s", "bad"] = bad
    return source


def test_one_bad_table_stops_no_other(spark, root):
    with pytest.raises(SnapshotError, match="s.bad"):
        snapshot_full(broken(spark), root, "one", DAYS[0])
    found = {r["table_name"]: r for r in read_manifest(spark, root).collect()}
    assert {n: r["status"] for n, r in found.items()} == {"good": "ok", "other": "ok", "bad": "failed"}
    assert "broken disk" in found["bad"]["error"]
    assert values(restore.restored_tables(spark, root), "good") == [1, 2]


def test_errors_can_be_recorded_only(spark, root):
    options = SnapshotOptions(on_error="record")
    found = report(snapshot_full(broken(spark), root, "one", DAYS[0], options=options))
    assert found["bad"][2] == "failed" and found["good"][2] == "ok"


# several at once


@pytest.mark.parametrize("parallelism", [1, 2, 4])
def test_schemas_at_once(spark, root, data, parallelism):
    source = ParquetTables(spark, data, lambda n: "places" if n in ("nation", "region") else "rest")
    options = SnapshotOptions(parallelism=parallelism)
    found = report(snapshot_schemas(source, root, "places", "one", DAYS[0], options))
    assert found == {"nation": ("full", 25, "ok"), "region": ("full", 5, "ok")}


def test_jobs_run_at_most_so_many_at_a_time(spark):
    import threading
    import time

    running, most, lock = [0], [0], threading.Lock()

    def work(item):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.05)
        with lock:
            running[0] -= 1
        if item == 3:
            raise ValueError("three")
        return item * 2

    outcomes = run_jobs(spark, work, range(8), 3)
    assert most[0] <= 3
    assert [o[1] for o in outcomes] == [0, 2, 4, None, 8, 10, 12, 14]
    assert isinstance(outcomes[3][2], ValueError)
    for bad in ("4", 0):
        with pytest.raises(ValueError):
            run_jobs(spark, work, [1], bad)


# incremental


def test_incremental_needs_a_base(spark, root):
    with pytest.raises(NoBaseError):
        snapshot_incremental(frames(spark, a=[1]), root, "two", DAYS[1])


def test_full_and_incrementals_give_the_source_back(spark, root):
    days = [
        dict(a=[1, 2], b=[1], c=[1]),
        dict(a=[1, 3], b=[1], c=[1]),  # a changed
        dict(a=[1, 3], b=[1, 1], d=[7]),  # b grew, c dropped, d new
        dict(a=[3, 1], b=[1, 1], c=[5], d=[7]),  # c back, a only reordered
    ]
    snapshot_full(frames(spark, **days[0]), root, "day0", DAYS[0])
    expected = [
        {"a": "changed", "b": "unchanged", "c": "unchanged"},
        {"a": "unchanged", "b": "changed", "d": "new", "c": "dropped"},
        {"a": "unchanged", "b": "unchanged", "c": "new", "d": "unchanged"},
    ]
    for i, changes in enumerate(expected, 1):
        found = report(snapshot_incremental(frames(spark, **days[i]), root, f"day{i}", DAYS[i]))
        assert {name: change for name, (change, _, _) in found.items()} == changes
    for i, tables in enumerate(days):
        back = restore.restored_tables(spark, root, as_of=DAYS[i])
        assert {t for _, t in back.frames} == set(tables)
        for name, content in tables.items():
            assert values(back, name) == sorted(content)
    with pytest.raises(LookupError):
        restore.restored_tables(spark, root, as_of=datetime(2023, 1, 1))


def test_a_changed_schema_is_a_change(spark, root):
    snapshot_full(frames(spark, a=[1]), root, "one", DAYS[0])
    source = FrameTables(spark, {("s", "a"): spark.createDataFrame([(1,)], "v bigint")})
    assert report(snapshot_incremental(source, root, "two", DAYS[1]))["a"][0] == "changed"


def test_given_changes_are_taken_whole(spark, root):
    source = frames(spark, a=[1], b=[2])
    snapshot_full(source, root, "one", DAYS[0])
    changed = spark.createDataFrame([("s", "b")], "schema_name string, table_name string")
    found = report(snapshot_incremental(source, root, "two", DAYS[1], changed=changed))
    assert found == {"b": ("changed", 1, "ok")}


def test_unchanged_files_are_not_scanned(spark, root, tmp_path):
    folder = str(tmp_path / "tables")
    spark.range(10).write.parquet(f"{folder}/a.parquet")
    spark.range(10).write.parquet(f"{folder}/b.parquet")
    source = ParquetTables(spark, folder)
    snapshot_full(source, root, "one", DAYS[0])
    base = copies_as_of(read_manifest(spark, root)).collect()
    assert all(r["source_state"] for r in base)
    spark.range(10).write.mode("overwrite").parquet(f"{folder}/a.parquet")  # same rows, new files
    spark.range(1).write.mode("append").parquet(f"{folder}/b.parquet")
    read = []
    source.read = lambda schema, table: read.append(table) or ParquetTables.read(source, schema, table)
    found = report(snapshot_incremental(source, root, "two", DAYS[1]))
    assert found == {"a": ("unchanged", 10, "unchanged"), "b": ("changed", 11, "ok")}
    read.clear()
    found = report(snapshot_incremental(source, root, "three", DAYS[2]))
    assert found["b"] == ("unchanged", 11, "unchanged") and "b" not in read


def test_tables_left_out_are_not_dropped(spark, root):
    source = frames(spark, a=[1], b=[2])
    snapshot_full(source, root, "one", DAYS[0])
    only = select_tables(source.tables(), only="a")
    assert report(snapshot_incremental(source, root, "two", DAYS[1], tables=only)) == {
        "a": ("unchanged", 1, "unchanged")
    }


# validation and restore


def spoil(spark, root, name, snapshot_id="one"):
    """Replace the files of a copy by others of the same shape."""
    copy = (F.col("table_name") == name) & (F.col("snapshot_id") == snapshot_id)
    row = read_manifest(spark, root).where(copy).first()
    spark.createDataFrame([(99,)], "v int").write.mode("overwrite").parquet(row["path"])


def test_validation_finds_spoiled_and_missing_copies(spark, root):
    snapshot_full(frames(spark, a=[1], b=[1], c=[1, 2], d=[1]), root, "one", DAYS[0])
    spoil(spark, root, "a")
    spoil(spark, root, "c")
    row = read_manifest(spark, root).where("table_name = 'd'").first()
    files.delete(spark, row["path"])
    found = {r["table_name"]: r for r in restore.validate_snapshot(spark, root, "one").collect()}
    assert {n: r["valid"] for n, r in found.items()} == {"a": False, "b": True, "c": False, "d": False}
    assert found["a"]["row_count_ok"] and not found["a"]["fingerprint_ok"]
    assert not found["c"]["row_count_ok"] and not found["d"]["has_data"]


def test_restore_to_folder_modes(spark, root):
    target = f"{root}/target"
    snapshot_full(frames(spark, a=[1], b=[2]), root, "one", DAYS[0])
    snapshot_full(frames(spark, a=[5], b=[6]), root, "two", DAYS[1])
    first = restore.chosen_copies(spark, root, snapshot_id="one")
    assert restore.restore_to_folder(spark, first, target).count() == 2
    back = ParquetTables(spark, f"{target}/s", "s")
    assert values(back, "a") == [1]
    newest = restore.chosen_copies(spark, root)
    with pytest.raises(restore.TargetExistsError):
        restore.restore_to_folder(spark, newest, target)
    assert values(back, "a") == [1]
    restore.restore_to_folder(spark, newest, target, "force")
    assert (values(back, "a"), values(back, "b")) == ([5], [6])
    restore.restore_to_folder(spark, first, target, "append")
    assert (values(back, "a"), values(back, "b")) == ([1, 5], [2, 6])
    assert files.children(spark, target) == ["s"]
    with pytest.raises(ValueError):
        restore.restore_to_folder(spark, first, target, "merge")


@pytest.mark.parametrize("mode", ["force", "append"])
def test_a_spoiled_copy_leaves_the_target_alone(spark, root, mode):
    target = f"{root}/target"
    snapshot_full(frames(spark, a=[1], b=[2]), root, "one", DAYS[0])
    copies = restore.chosen_copies(spark, root)
    restore.restore_to_folder(spark, copies, target)
    spoil(spark, root, "b")
    with pytest.raises(restore.InvalidSnapshotError):
        restore.restore_to_folder(spark, copies, target, mode)
    back = ParquetTables(spark, f"{target}/s", "s")
    assert (values(back, "a"), values(back, "b")) == ([1], [2])


def test_a_move_that_fails_is_taken_back(spark, root, monkeypatch):
    target = f"{root}/target"
    snapshot_full(frames(spark, a=[1], b=[2], c=[3]), root, "one", DAYS[0])
    snapshot_full(frames(spark, a=[5], b=[6], c=[7]), root, "two", DAYS[1])
    first = restore.chosen_copies(spark, root, snapshot_id="one", tables="a,b")
    restore.restore_to_folder(spark, first, target)
    rename, moved = files.rename, []

    def failing(session, old, new):
        moved.append(new)
        if len(moved) == 4:  # the second table, its old copy already aside
            raise IOError("no rename")
        rename(session, old, new)

    monkeypatch.setattr(files, "rename", failing)
    with pytest.raises(IOError):
        restore.restore_to_folder(spark, restore.chosen_copies(spark, root), target, "force")
    back = ParquetTables(spark, f"{target}/s", "s")
    assert back.names() == ["a", "b"]
    assert (values(back, "a"), values(back, "b")) == ([1], [2])


def test_restore_to_catalog(spark, root):
    spark.sql("DROP DATABASE IF EXISTS s CASCADE")
    snapshot_full(frames(spark, a=[1], b=[2]), root, "one", DAYS[0])
    snapshot_full(frames(spark, a=[5], b=[6]), root, "two", DAYS[1])
    first = restore.chosen_copies(spark, root, snapshot_id="one")
    place = f"{root}/catalog"
    restore.restore_to_catalog(spark, first, place)
    tables = CatalogTables(spark, ["s"])
    assert rows(tables.tables()) == [("s", "a"), ("s", "b")]
    assert values(tables, "a") == [1]
    with pytest.raises(restore.TargetExistsError):
        restore.restore_to_catalog(spark, first, place)
    restore.restore_to_catalog(spark, restore.chosen_copies(spark, root), place, "force")
    assert values(tables, "a") == [5]
    restore.restore_to_catalog(spark, first, place, "append")
    assert values(tables, "a") == [1, 5]
    spoil(spark, root, "b", "two")
    with pytest.raises(restore.InvalidSnapshotError):
        newest = restore.chosen_copies(spark, root, snapshot_id="two")
        restore.restore_to_catalog(spark, newest, place, "force")
    assert values(tables, "b") == [2, 6]
    # the catalog is a source as well; views are not tables
    spark.sql("CREATE VIEW s.seen AS SELECT * FROM s.a")
    assert rows(tables.tables()) == [("s", "a"), ("s", "b")]
    snapshot_full(tables, f"{root}/again", "one", DAYS[0])
    assert values(restore.restored_tables(spark, f"{root}/again"), "a") == [1, 5]
    spark.sql("DROP DATABASE s CASCADE")


def test_choosing_tables_to_restore(spark, root):
    snapshot_full(frames(spark, a=[1], b=[2]), root, "one", DAYS[0])
    assert restore.chosen_copies(spark, root, tables="s.a").count() == 1
    assert restore.chosen_copies(spark, root, tables="b", schemas="s").count() == 1
    assert restore.chosen_copies(spark, root, snapshot_id="none").count() == 0


# retention


def test_retention_deletes_planned_copies_only(spark, root):
    for day, tables in ((0, dict(a=[0], b=[0])), (3, dict(a=[1])), (6, dict(a=[2]))):
        snapshot_full(frames(spark, **tables), root, f"day{day}", DAYS[day])
    before = {(r["table_name"], r["snapshot_id"]): r["path"] for r in read_manifest(spark, root).collect()}
    gone = paths(rotation.retention_apply(spark, root, DAYS[8], days=3))
    assert gone == sorted([before["a", "day0"], before["a", "day3"]])
    assert {k for k, p in before.items() if files.exists(spark, p)} == {("a", "day6"), ("b", "day0")}
    left = from_manifest(read_manifest(spark, root))
    assert sorted(r["name"] for r in left.collect()) == ["s.a@day6", "s.b@day0"]
    assert restore_points(left, DAYS[8]).count() == 2
    assert paths(rotation.retention_apply(spark, root, DAYS[8], days=3)) == []


def test_what_replaced_and_failed_runs_left_goes_too(spark, root):
    snapshot_full(frames(spark, a=[1]), root, "one", DAYS[0])
    old = read_manifest(spark, root).first()["path"]
    snapshot_full(broken(spark), root, "two", DAYS[0], options=SnapshotOptions(on_error="record"))
    bad = read_manifest(spark, root).where("status = 'failed'").first()["path"]
    snapshot_full(frames(spark, a=[2]), root, "one", DAYS[1])
    assert files.exists(spark, old)
    assert paths(rotation.retention_apply(spark, root, DAYS[1], days=3)) == []
    gone = paths(rotation.retention_apply(spark, root, DAYS[8], days=3))
    assert set(gone) == {old, bad} and not files.exists(spark, old)
    assert paths(rotation.retention_apply(spark, root, DAYS[8], days=3)) == []
    assert values(restore.restored_tables(spark, root), "a") == [2]


def test_a_base_and_the_newest_copy_are_kept(spark, root):
    snapshot_full(frames(spark, a=[0], b=[0]), root, "day0", DAYS[0])
    snapshot_incremental(frames(spark, a=[1], b=[1]), root, "day1", DAYS[1])
    snapshot_incremental(frames(spark, a=[2], b=[1]), root, "day7", DAYS[7])
    rotation.retention_apply(spark, root, DAYS[8], days=3)
    back = restore.restored_tables(spark, root)
    assert (values(back, "a"), values(back, "b")) == ([2], [1])
    left = from_manifest(read_manifest(spark, root))
    assert sorted(r["name"] for r in left.collect()) == ["s.a@day0", "s.a@day7", "s.b@day0", "s.b@day1"]


# sources


def test_unknown_schema(spark, data):
    with pytest.raises(ValueError):
        ParquetTables(spark, data).read("other", "orders")


def test_jdbc_options(spark):
    source = JdbcTables(
        spark,
        "jdbc:postgresql://host/db",
        {"user": "u", "fetchsize": "500"},
        {"s.t": {"partitionColumn": "id", "lowerBound": "0", "upperBound": "9", "numPartitions": "4"}},
    )
    options = source.read_options("s", "t")
    assert options["dbtable"] == '"s"."t"' and options["fetchsize"] == "500"
    assert options["numPartitions"] == "4" and options["user"] == "u"
    assert "numPartitions" not in source.read_options("s", "other")
