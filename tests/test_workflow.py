from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tablekeep.__main__ import run
from tablekeep.operators.catalogue import NoArtifactError, artifact_list, snapshots
from tablekeep.plans import copies as copies_module, snapshot as snapshot_module
from tablekeep.plans.manifest import read_manifest
from tablekeep.plans.restore import TargetExistsError
from tablekeep.plans.snapshot import SnapshotError
from tablekeep.plans.workflow import back_up, find_snapshot, restore_snapshot
from tablekeep.sources.tables import ParquetTables
from tests.test_snapshots import frames, values


def test_back_up_then_rotate(spark, root):
    back_up(frames(spark, a=[1]), root, "old", datetime(2024, 1, 1))
    back_up(frames(spark, a=[2]), root, "new", datetime(2024, 3, 1), retention_days=30)
    assert [r["name"] for r in snapshots(read_manifest(spark, root)).collect()] == ["new"]
    back_up(frames(spark, a=[3]), root, "newer", datetime(2024, 6, 1), retention_days=None)
    found = artifact_list(snapshots(read_manifest(spark, root)), by="name").collect()
    assert [(r["name"], r["tables"]) for r in found] == [("new", 1), ("newer", 1)]


def test_a_copy_that_reads_back_wrong_is_failed(spark, root, monkeypatch):
    def wrong(df):
        return {"row_count": -1, "fingerprint": 0}

    monkeypatch.setattr(snapshot_module, "measure", wrong)
    with pytest.raises(SnapshotError):
        back_up(frames(spark, a=[1]), root, "one", datetime(2024, 1, 1))
    row = read_manifest(spark, root).first()
    assert row["status"] == "failed" and "written were" in row["error"]
    assert copies_module.measure is not wrong


def test_finding_and_restoring(spark, root):
    back_up(frames(spark, a=[1], b=[1]), root, "full_20240101", datetime(2024, 1, 1))
    changed = frames(spark, a=[2], b=[1])
    back_up(changed, root, "incr_20240102", datetime(2024, 1, 2), incremental=True)
    assert find_snapshot(spark, root)["name"] == "incr_20240102"
    assert find_snapshot(spark, root, name="full")["name"] == "full_20240101"
    assert find_snapshot(spark, root, day="2024-01-01")["kind"] == "full"
    with pytest.raises(NoArtifactError):
        find_snapshot(spark, root, name="nothing")
    with pytest.raises(NoArtifactError):
        find_snapshot(spark, f"{root}/none")
    target = f"{root}/target"
    restore_snapshot(spark, root, target)
    back = ParquetTables(spark, f"{target}/s", "s")
    assert (values(back, "a"), values(back, "b")) == ([2], [1])
    restore_snapshot(spark, root, target, name="full", tables="a", mode="force")
    assert values(back, "a") == [1]


def test_command_line(spark, root, data):
    common = ["--root", root]
    taken = run(
        spark,
        ["backup", *common, "--source", data, "--backup-name", "first", "--tables", "orders,region,part"]
        + ["--exclude-tables", "part", "--parallel-jobs", "2"],
    )
    assert sorted(r["table_name"] for r in taken.collect()) == ["orders", "region"]
    more = run(spark, ["backup", *common, "--source", data, "--incremental", "--tables", "orders"])
    assert [r["change"] for r in more.collect()] == ["unchanged"]
    assert [r["name"] for r in run(spark, ["list", *common]).collect()] == ["first"]
    assert run(spark, ["validate", *common, "--backup-name", "fir"]).where("valid").count() == 2
    assert run(spark, ["usage", *common]).where(F.col("level") == 3).first()["artifacts"] == 2
    to = ["restore", *common, "--target", f"{root}/out"]
    run(spark, to)
    with pytest.raises(TargetExistsError):
        run(spark, to)
    run(spark, [*to, "--force", "--tables", "region"])
    run(spark, [*to, "--append", "--tables", "region"])
    assert spark.read.parquet(f"{root}/out/public/region.parquet").count() == 10
    assert run(spark, ["rotate", *common]) == []


def test_command_line_for_files_and_catalogs(spark, root, data):
    folder = f"{root}/plain"
    spark.range(3).selectExpr("cast(id AS string) v").coalesce(1).write.text(folder)
    listed = run(spark, ["list", "--files", folder, "--pattern", "part-*"]).collect()
    assert len(listed) == 1 and listed[0]["size_bytes"] == 6
    assert run(spark, ["rotate", "--files", folder, "--pattern", "part-*"]) == []
    assert len(run(spark, ["rotate", "--files", folder, "--pattern", "part-*", "--retention-days", "0", "--rule", "exact"])) == 1
    run(spark, ["backup", "--root", f"{root}/r", "--source", data, "--schema", "cli_db", "--tables", "region"])
    spark.sql("DROP DATABASE IF EXISTS cli_db CASCADE")
    run(spark, ["restore", "--root", f"{root}/r", "--catalog", f"{root}/c"])
    assert spark.table("cli_db.region").count() == 5
    for wrong in (["list"], ["backup", "--root", root, "--since", "2024-01-01"], ["restore", "--root", root]):
        with pytest.raises(SystemExit):
            run(spark, wrong)


def test_database_options(spark, root, monkeypatch):
    """No database here: what the command line hands over."""
    import tablekeep.__main__ as cli

    seen = {}
    monkeypatch.setattr(cli, "JdbcTables", lambda spark, url, options: seen.update(url=url, options=options) or frames(spark, a=[1]))
    arguments = ["backup", "--root", root, "--jdbc-url", "jdbc:x://h/d", "--jdbc-option", "user=u", "--jdbc-option", "password=a=b"]
    run(spark, arguments)
    assert seen == {"url": "jdbc:x://h/d", "options": {"user": "u", "password": "a=b"}}
    monkeypatch.setattr(cli, "restore_to_jdbc", lambda *a: seen.update(restored=a[2:]) or spark.range(1))
    run(spark, ["restore", "--root", root, "--jdbc-url", "jdbc:x://h/d", "--append"])
    assert seen["restored"] == ("jdbc:x://h/d", "append", {})


def test_scratch_folders_can_be_released(spark):
    from tablekeep import session

    kept, session._scratch[:] = session._scratch[:], []
    path = session.scratch_folder(spark, "release")
    spark.range(3).write.parquet(path)
    assert session.release_scratch(spark) == [path]
    assert not session.files.exists(spark, path)
    session._scratch[:] = kept
