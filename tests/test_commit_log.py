"""The log of commits: checkpoints, writers at the same time, bounded reads."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from tablekeep.plans import commit_log
from tablekeep.plans.commit_log import CommitLog
from tablekeep.plans.manifest import append_manifest, manifest_log, read_manifest
from tablekeep.sources import files

DDL = "a bigint, b string"


@pytest.fixture(autouse=True)
def no_hints():
    """Each test is a new process that knows of no log."""
    commit_log._newest.clear()


def values(log, until=None):
    return sorted(r["a"] for r in log.read(until).collect())


def test_rows_of_all_commits(spark, root):
    log = CommitLog(spark, root, DDL, every=3)
    assert values(log) == [] and log.append([]) == 0
    for i in range(8):
        assert log.append([{"a": i}, (i, "x")]) == i + 1
    assert values(log) == sorted([*range(8)] * 2)
    assert log.read().where("b IS NULL").count() == 8
    assert values(log, 4) == sorted([*range(4)] * 2)


def test_reading_opens_one_checkpoint_and_the_commits_after_it(spark, root):
    log = CommitLog(spark, root, DDL, every=10)
    for i in range(57):
        log.append([(i, "")])
        assert len(log.paths()) <= 10
    assert [p.rsplit("/", 1)[1] for p in log.paths()] == [
        "000000000050", *[f"{n:012d}.parquet" for n in range(51, 58)]
    ]
    assert values(log) == list(range(57))


def test_ten_thousand_commits(spark, root):
    log = CommitLog(spark, root, DDL, every=1000)
    for i in range(10_000):
        log.append([(i, "x")])
    assert len(log.paths()) == 1
    assert log.read().selectExpr("count(*)", "sum(a)").first()[:] == (10_000, 49_995_000)


def test_two_writers_of_one_number_cannot_both_win(spark, root):
    path = f"{root}/commits/x/1"
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: files.write_new(spark, path, b"%d" % i * 1000), range(64)))
    assert won.count(True) == 1
    assert files.read_bytes(spark, path) == b"%d" % won.index(True) * 1000
    assert os.listdir(files.local_path(spark, f"{root}/commits/x")) == ["1"]


def test_writers_at_the_same_time_keep_all_rows(spark, root):
    def write(number):
        log = CommitLog(spark, root, DDL, every=7)
        for i in range(15):
            if i % 5 == 0:
                commit_log._newest.pop(log.folder, None)  # as a process that starts
            log.append([(100 * number + i, "x")])

    with ThreadPoolExecutor(6) as pool:
        list(pool.map(write, range(6)))
    log = CommitLog(spark, root, DDL, every=7)
    assert values(log) == sorted(100 * n + i for n in range(6) for i in range(15))
    assert log.append([]) == 90


def test_a_writer_that_died_before_its_checkpoint_is_made_up_for(spark, root, monkeypatch):
    log = CommitLog(spark, root, DDL, every=4)
    monkeypatch.setattr(CommitLog, "checkpoint", lambda self, number: None)
    for i in range(9):
        log.append([(i, "")])
    monkeypatch.undo()
    commit_log._newest.clear()
    assert len(log.paths()) == 9
    log.append([(9, "")])
    assert len(log.paths()) == 1 and values(log) == list(range(10))


def test_what_checkpoints_replaced_goes_with_its_age(spark, root, monkeypatch):
    log = CommitLog(spark, root, DDL, every=2)
    for i in range(6):
        log.append([(i, "")])
    before = log.read(2)
    assert len(files.children(spark, f"{root}/checkpoints")) == 3  # none is a day old
    monkeypatch.setattr(commit_log, "KEPT_SECONDS", -5)
    for i in range(6, 12):
        log.append([(i, "")])
    assert values(log) == list(range(12))
    assert [int(n) for n in files.children(spark, f"{root}/checkpoints")] == [10, 12]
    left = [n for b in files.children(spark, f"{root}/commits") for n in files.children(spark, f"{root}/commits/{b}")]
    assert [int(n[:12]) for n in left] == [9, 10, 11, 12]
    assert before is not None


def test_a_manifest_is_such_a_log(spark, root):
    for i in range(30):
        row = {"snapshot_id": f"s{i}", "run_id": f"{i:02d}", "status": "ok", "kind": "full", "path": f"p{i}"}
        append_manifest(spark, root, [{**row, "schema_name": "s", "table_name": "t"}])
    assert read_manifest(spark, root).count() == 30
    assert len(manifest_log(spark, root).paths()) == 7


def test_commits_of_many_tasks(spark, root, monkeypatch):
    log = CommitLog(spark, root, DDL, every=100)
    log.append([(-1, "x")])
    frame = spark.range(0, 2530, 1, 3).selectExpr("id AS a")
    assert log.append_each(frame) == 2531
    assert values(log) == list(range(-1, 2530)) and values(log, 1) == [-1]
    assert [p.rsplit("/", 1)[1] for p in log.paths()] == [
        "000000002500", *[f"{n:012d}.parquet" for n in range(2501, 2532)]
    ]
    assert log.append([(7, "")]) == 2532 and log.append_each(frame.where("false")) == 2532
    assert sorted(files.children(spark, root)) == ["checkpoints", "commits"]


def test_commits_of_many_tasks_beside_another_writer(spark, root, monkeypatch):
    """Numbers that another writer takes meanwhile are his, and the rows go after the others."""
    log = CommitLog(spark, root, DDL, every=10)
    for number in (3, 17, 31, 32):
        files.write_new(spark, log._commit(number), b"")
    buffer = commit_log.io.BytesIO()
    row = commit_log.pa.Table.from_pylist([{"a": 1000, "b": "other"}], schema=commit_log.to_arrow_schema(log.schema))
    commit_log.pq.write_table(row, buffer)
    for number in (3, 17, 31, 32):
        with open(files.local_path(spark, log._commit(number)), "wb") as file:
            file.write(buffer.getvalue())
    assert log.append_each(spark.range(30).selectExpr("id AS a")) == 34
    assert values(log) == [*range(30), *[1000] * 4]
    assert len(log.paths()) == 5


def test_no_checkpoint_over_a_gap_and_gaps_are_filled(spark, root):
    log = CommitLog(spark, root, DDL, every=4)
    for number in (1, 2, 4, 5):
        log.append([(number, "")])
        commit_log._newest[log.folder] = number + (number == 2), 0
    log.checkpoint(5)
    assert files.children(spark, f"{root}/checkpoints") == []
    commit_log._newest.clear()
    assert log.append([(3, "")]) == 3
    commit_log._newest.clear()
    assert log.append([(6, "")]) == 6 and len(log.paths()) == 1 and values(log) == [1, 2, 3, 4, 5, 6]
