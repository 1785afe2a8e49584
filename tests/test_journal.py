"""Restores that die at any step end in all old or all new tables."""

import pytest

from tablekeep.plans import journal, restore
from tablekeep.plans.snapshot import snapshot_full
from tablekeep.sources import files
from tests.conftest import rows
from tests.test_snapshots import DAYS, frames

NAMES = ["a", "b", "c"]


class Killed(BaseException):
    """The process dies: nothing that handles errors runs."""


class Steps:
    """Counts the calls that change something and dies or fails before one of them."""

    def __init__(self, monkeypatch, at, error):
        self.count, self.at, self.error, self.failed = 0, at, error, False
        for name in ("rename", "delete", "write_new"):
            monkeypatch.setattr(files, name, self.watched(getattr(files, name)))
        for name in ("_rename", "_drop"):
            monkeypatch.setattr(journal._Tables, name, self.watched(getattr(journal._Tables, name)))

    def watched(self, call):
        def step(*args):
            self.count += 1
            if self.count == self.at and not self.failed:
                self.failed = True
                raise self.error
            return call(*args)

        return step


def two_days(spark, root):
    for day, shift in ((0, 0), (1, 10)):
        tables = {n: [shift, shift + 1] for n in NAMES[: 2 + day]}
        snapshot_full(frames(spark, **tables), root, f"day{day}", DAYS[day])
    return [restore.chosen_copies(spark, root, snapshot_id=f"day{day}") for day in (0, 1)]


def state(spark, target):
    return {
        n: [r[0] for r in rows(spark.read.parquet(f"{target}/s/{n}.parquet"))]
        for n in NAMES
        if files.exists(spark, f"{target}/s/{n}.parquet")
    }


OLD = {"a": [0, 1], "b": [0, 1]}
NEW = {n: [10, 11] for n in NAMES}
BOTH = {"a": [0, 1, 10, 11], "b": [0, 1, 10, 11], "c": [10, 11]}


@pytest.mark.parametrize("mode, after", [("force", NEW), ("append", BOTH)])
@pytest.mark.parametrize("error", [Killed(), OSError("no")])
def test_folders(spark, root, monkeypatch, mode, after, error):
    old, new = two_days(spark, root)
    seen, at = set(), 0
    while True:
        at += 1
        target = f"{root}/to{at}"
        restore.restore_to_folder(spark, old, target)
        with monkeypatch.context() as patch:
            steps = Steps(patch, at, error)
            try:
                restore.restore_to_folder(spark, new, target, mode)
            except (Killed, OSError):
                pass
        journal.recover(spark, target)
        found = state(spark, target)
        assert found in (OLD, after), (at, found)
        assert not files.children(spark, f"{target}/_journal")
        seen.add(str(found))
        if not steps.failed:
            break
    assert at >= 8 and len(seen) == 2 and found == after


def test_a_death_while_a_failed_restore_is_turned_back(spark, root, monkeypatch):
    old, new = two_days(spark, root)
    for at in range(1, 30):
        target = f"{root}/to{at}"
        restore.restore_to_folder(spark, old, target)
        renames = {"n": 0, "later": 0}
        real = files.rename

        def rename(spark, source, place):
            renames["n"] += 1
            if renames["n"] == 4:
                raise OSError("no")
            if renames["n"] > 4:
                renames["later"] += 1
                if renames["later"] == at:
                    raise Killed()
            return real(spark, source, place)

        with monkeypatch.context() as patch:
            patch.setattr(files, "rename", rename)
            with pytest.raises((Killed, OSError)):
                restore.restore_to_folder(spark, new, target, "force")
        journal.recover(spark, target)
        assert state(spark, target) == OLD
        if renames["later"] < at:
            break
    assert at > 2


def catalog_state(spark, database):
    return {n: [r[0] for r in rows(spark.table(f"{database}.{n}"))] for n in NAMES if spark.catalog.tableExists(f"{database}.{n}")}


@pytest.mark.parametrize("error", [Killed(), OSError("no")])
def test_catalog(spark, root, monkeypatch, error):
    old, new = two_days(spark, root)
    seen, at = set(), 0
    while True:
        at += 1
        database, place = f"journal_{type(error).__name__}_{at}", f"{root}/c{at}"
        spark.sql(f"CREATE DATABASE {database} LOCATION '{root}/{database}'")
        restore.restore_to_catalog(spark, old, place, database=database)
        with monkeypatch.context() as patch:
            steps = Steps(patch, at, error)
            try:
                restore.restore_to_catalog(spark, new, place, "force", database)
            except (Killed, OSError):
                pass
        journal.recover(spark, place)
        found = catalog_state(spark, database)
        assert found in (OLD, NEW), (at, found)
        if steps.failed and at > 1:  # before the intent was written nothing can be tidied up
            assert {t.name for t in spark.catalog.listTables(database)} == set(found)
        seen.add(str(found))
        if not steps.failed:
            break
    assert at >= 6 and len(seen) == 2 and found == NEW


def test_the_next_restore_ends_what_the_last_left(spark, root, monkeypatch):
    old, new = two_days(spark, root)
    target = f"{root}/to"
    restore.restore_to_folder(spark, old, target)
    with monkeypatch.context() as patch:
        Steps(patch, 4, Killed())
        with pytest.raises(Killed):
            restore.restore_to_folder(spark, new, target, "force")
    assert state(spark, target) not in (OLD, NEW)
    restore.restore_to_folder(spark, old, target, "append")
    assert state(spark, target) == {"a": [0, 1, 10, 11], "b": [0, 1, 10, 11], "c": [10, 11]}
