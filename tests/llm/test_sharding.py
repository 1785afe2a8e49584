from collections import Counter, defaultdict

import pytest

from tablekeep.llm import sharding
from tests.llm.samples import DOC_SCHEMA, frame


def assigned(spark, rows, shards, **options):
    df = spark.createDataFrame(rows, "id long, source string")
    return [tuple(r) for r in sharding.assign_shards(df, "source", shards, **options).collect()]


def holds(result, rows, shards):
    assert Counter((r[0], r[1]) for r in result) == Counter(rows)
    by_shard = defaultdict(list)
    for _, source, shard, slot in result:
        by_shard[shard].append((slot, source))
    sizes = [len(by_shard[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for held in by_shard.values():
        assert sorted(slot for slot, _ in held) == list(range(len(held)))
    totals = Counter(source for _, source in rows)
    for source, total in totals.items():
        for s in range(shards):
            share = sum(x == source for _, x in by_shard[s])
            assert abs(share - total / shards) <= 2


@pytest.mark.parametrize("shards", [1, 3, 16])
@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_mixture(spark, shards, buckets):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}") for i in range(500)]
    holds(assigned(spark, rows, shards, buckets=buckets), rows, shards)


def test_many_strata_of_one_row(spark):
    rows = [(i, f"s{i}") for i in range(300)]
    sizes = Counter(r[2] for r in assigned(spark, rows, 8))
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_null_stratum_and_repeated_rows(spark):
    rows = [(None, None)] * 90 + [(1, "")] * 60 + [(i, "a") for i in range(90)]
    holds(assigned(spark, rows, 4), rows, 4)


def test_depends_on_rows_and_seed_only(spark):
    rows = [(i, f"s{i % 3}") for i in range(100)]
    first = sorted(assigned(spark, rows, 4))
    assert first == sorted(assigned(spark, rows[::-1], 4))
    assert first != sorted(assigned(spark, rows, 4, seed=1))


def test_empty_and_clashing_names(spark):
    assert assigned(spark, [], 4) == []
    df = spark.createDataFrame([(1, "x", 5, 6, "c")], "id long, source string, Shard int, slot int, c0 string")
    result = sharding.assign_shards(df, "source", 2)
    assert result.columns == ["id", "source", "c0", "shard", "slot"]
    assert [tuple(r) for r in result.collect()] == [(1, "x", "c", 0, 0)]


def test_whole_rows(spark):
    result = sharding.shard_rows(frame(spark), "source", 4)
    rows = result.collect()
    assert Counter(tuple(r)[:5] for r in rows) == Counter(tuple(r) for r in frame(spark).collect())
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)
    assert result.drop("shard", "slot").schema.simpleString() == spark.createDataFrame([], DOC_SCHEMA).schema.simpleString()
