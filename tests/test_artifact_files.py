"""Files on storage: listings, dump text, gzip, empty files."""

import gzip
import os
from datetime import datetime, timedelta, timezone

import pytest

from tablekeep.operators.validate import publishable, validate_artifacts
from tablekeep.plans.rotation import rotate_files
from tablekeep.sources import files, listing
from tablekeep.sources.artifacts import dump_lines, list_files
from tests.conftest import rows

DUMPS = {
    "backup_a.sql.gz": "CREATE TABLE a();\nCOPY a\n",
    "backup_b.sql.gz": "CREATE TABLE b();\n",
    "backup_c.sql.gz": "",
    "backup_d.sql.gz": "COPY d\n" * 3,
    "backup_e f+%20.sql.gz": "-- x\nCREATE TABLE e();\n\nCOPY e\n",
}


@pytest.fixture()
def folder(tmp_path):
    for name, text in DUMPS.items():
        (tmp_path / name).write_bytes(gzip.compress(text.encode()))
        os.utime(tmp_path / name, (1710504000, 1710504000))
    (tmp_path / "notes.txt").write_text("CREATE TABLE COPY")
    (tmp_path / "backup_z.sql.gz").write_bytes(b"")
    return str(tmp_path)


def test_listing(spark, folder):
    found = {r["name"]: r for r in list_files(spark, folder, "backup_*.sql.gz").collect()}
    assert set(found) == {*DUMPS, "backup_z.sql.gz"}
    assert found["backup_a.sql.gz"]["modified_at"] == datetime(2024, 3, 15, 12)
    assert found["backup_z.sql.gz"]["size_bytes"] == 0
    assert list_files(spark, folder).count() == 7


def test_conditions_are_tested_where_files_are_listed(spark, folder):
    os.utime(f"{folder}/notes.txt", (0, 0))
    listed = list_files(spark, folder).where("modified_at >= TIMESTAMP_NTZ '2024-01-01'")
    listed = listed.where("name LIKE 'backup%' AND size_bytes < 1000")
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "file_listing" in plan and "Filter" not in plan.replace("RuntimeFilters", "")
    assert {r["name"] for r in listed.collect()} == {*DUMPS, "backup_z.sql.gz"}


def test_folders_are_partitions_and_no_path_is_on_the_driver(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"d{i}" / "deep" / "er").mkdir(parents=True)
        for j in range(3):
            (tmp_path / f"d{i}" / "deep" / "er" / f"backup_{j}").write_text("x" * j)
        (tmp_path / f"d{i}" / "_hidden").write_text("x")
    (tmp_path / "backup_top").write_text("")
    reader = listing.ListingReader({"path": str(tmp_path), "recursive": "true"})
    parts = [p.folders for p in reader.partitions()]
    assert sorted(parts) == [[(str(tmp_path), False)], *[[(f"{tmp_path}/d{i}", True)] for i in range(5)]]
    for depth in (0, 1, 2, 3, 9):
        found = listing.listing(spark, str(tmp_path), "backup_*", recursive=True, depth=depth)
        assert rows(found.groupBy("size_bytes").count()) == [(0, 6), (1, 5), (2, 5)]


def test_many_files_in_one_folder_and_odd_names(spark, tmp_path):
    names = {f"backup_{i} ü+%20#?.gz" for i in range(12_000)}
    for name in names:
        (tmp_path / name).touch()
    found = list_files(spark, f"file://{tmp_path}")
    assert {r["name"] for r in found.collect()} == names
    with pytest.raises(Exception, match="none"):
        list_files(spark, f"{tmp_path}/none").collect()


def test_listing_below_folders(spark, tmp_path):
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "x" / "y" / "backup_1.sql").write_text("1")
    assert list_files(spark, str(tmp_path), "backup_*.sql", recursive=True).count() == 1


def test_validation_reports_empty_dumps(spark, folder):
    listing = list_files(spark, folder, "backup_*.sql.gz")
    lines = dump_lines(spark, folder, "backup_*.sql.gz")
    checked = validate_artifacts(listing, lines)
    assert rows(checked) == [
        ("backup_a.sql.gz", True, True, True),
        ("backup_b.sql.gz", True, False, False),
        ("backup_c.sql.gz", False, False, False),
        ("backup_d.sql.gz", False, True, False),
        ("backup_e f+%20.sql.gz", True, True, True),
        ("backup_z.sql.gz", False, False, False),
    ]
    by_path = validate_artifacts(listing, lines, "path")
    assert rows(by_path.drop("path")) == rows(checked.drop("name"))
    assert [r["name"] for r in publishable(checked).orderBy("name").collect()] == [
        "backup_a.sql.gz",
        "backup_e f+%20.sql.gz",
    ]


@pytest.mark.parametrize("rule, left", [("whole_days", "abde"), ("exact", "abd")])
def test_old_files_are_deleted(spark, folder, rule, left):
    now = datetime(2024, 6, 1, tzinfo=timezone.utc)
    ages = {"a": 0, "b": 3, "c": 31, "d": 30, "e f+%20": 30.5, "z": 400}
    for name, days in ages.items():
        at = (now - timedelta(days=days)).timestamp()
        os.utime(f"{folder}/backup_{name}.sql.gz", (at, at))
    os.utime(f"{folder}/notes.txt", (0, 0))
    gone = rotate_files(spark, folder, now.replace(tzinfo=None), "backup_*.sql.gz", 30, rule)
    assert gone.count() == len(ages) - len(left)
    there = files.children(spark, folder)
    assert "".join(n[7] for n in there if n.startswith("backup_")) == left
    assert "notes.txt" in there


def test_file_calls(spark, folder):
    assert files.exists(spark, folder) and not files.exists(spark, f"{folder}/none")
    assert files.size_bytes(spark, f"{folder}/notes.txt") == 17
    assert "notes.txt" in files.children(spark, folder)
    files.rename(spark, f"{folder}/notes.txt", f"{folder}/new/notes.txt")
    assert files.exists(spark, f"{folder}/new/notes.txt")
    with pytest.raises(IOError):
        files.rename(spark, f"{folder}/none", f"{folder}/other")
    assert files.delete(spark, f"{folder}/new") and not files.delete(spark, f"{folder}/new")
