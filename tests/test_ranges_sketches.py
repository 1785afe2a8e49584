"""Ranges of equal depth and sketches that are merged."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tablekeep.operators.ranges import KeyRange, equi_depth, range_counts
from tablekeep.operators.sketches import estimates, merged, sketches
from tablekeep.plans.copies import copy_sketches
from tablekeep.plans.manifest import read_manifest
from tablekeep.plans.snapshot import SnapshotOptions, snapshot_full
from tablekeep.sources.tables import FrameTables, JdbcTables
from tests.conftest import rows
from tests.test_snapshots import DAYS


def counts(df, key, parts):
    found = equi_depth(df, key, parts)
    return found, [r["row_count"] for r in range_counts(df, key, found).orderBy("number").collect()]


@pytest.mark.parametrize("key", ["l_orderkey", "l_extendedprice", "l_shipdate"])
def test_ranges_hold_equally_many_rows(spark, data, key):
    df = spark.read.parquet(f"{data}/lineitem.parquet")
    found, held = counts(df, key, 10)
    assert len(found) == 10 and sum(held) == df.count()
    assert all(0.9 <= n * 10 / df.count() <= 1.1 for n in held)


def test_a_hot_value_has_a_range_of_its_own(spark):
    df = spark.range(900).select(F.when(F.col("id") < 600, 500).otherwise(F.col("id")).alias("a b"))
    found, held = counts(df, "a b", 6)
    assert KeyRange(only=500) in found and 600 in held or 601 in held
    assert sum(held) == 900 and max(n for n in held if n < 600) <= 160


@pytest.mark.parametrize("values", [[], [None], [None, None, 3], [7] * 5, [1, 2]])
def test_few_rows_and_nulls_are_all_in_one_range_each(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "k int")
    for parts in (1, 4):
        found, held = counts(df, "k", parts)
        assert sum(held) == len(values)
        assert any(r.null for r in found) == (None in values)
    with pytest.raises(ValueError):
        equi_depth(df, "k", 0)


def test_predicates():
    low, high = datetime(2024, 1, 1, 2, 3, 4, 5), datetime(2024, 2, 1)
    assert KeyRange(low=low, high=high).predicate("t") == (
        "t > TIMESTAMP '2024-01-01 02:03:04.000005' AND t <= TIMESTAMP '2024-02-01 00:00:00'"
    )
    assert KeyRange(high=date(2024, 1, 1), open=True).predicate("d") == "d < DATE '2024-01-01'"
    assert KeyRange().predicate("k") == "k IS NOT NULL" and KeyRange(null=True).predicate("k") == "k IS NULL"
    assert KeyRange(only=0.1).predicate("x") == "x = 0.1"


def test_databases_are_read_by_ranges(spark, monkeypatch):
    """The options that would be used; no database is asked."""
    asked = {}
    source = JdbcTables(spark, "jdbc:x", {"user": "u"}, ranges={"s.t": ["k <= 1", "k > 1"]})
    monkeypatch.setattr(type(spark.read), "jdbc", lambda self, *a, **k: asked.update(a=a, **k))
    source.read("s", "t")
    assert asked["a"] == ("jdbc:x", '"s"."t"') and asked["predicates"] == ["k <= 1", "k > 1"]
    assert asked["properties"] == {"fetchsize": "10000", "user": "u"}
    keys = spark.range(100).withColumnRenamed("id", "k")
    monkeypatch.setattr(source, "_query", lambda query: asked.update(query=query) or keys)
    found = source.key_ranges("s", "t", "k", 4)
    assert asked["query"] == 'SELECT "k" FROM "s"."t"' and len(found) == 4 and found[0] == '"k" <= 24'


def test_merged_sketches_are_those_of_the_whole(spark, data):
    df = spark.read.parquet(f"{data}/lineitem.parquet")
    parts = [df.where(F.col("l_linenumber") == n) for n in range(1, 8)]
    apart = sketches(parts[0])
    for part in parts[1:]:
        apart = apart.unionAll(sketches(part))
    found = {r["column_name"]: r for r in estimates(merged(apart), [0.1, 0.5]).collect()}
    for name in df.columns:
        exact = df.select(name).distinct().count()
        assert abs(found[name]["distinct_count"] - exact) <= 0.03 * exact
        assert found[name]["row_count"] == df.count()
    rank = df.where(F.col("l_extendedprice") <= found["l_extendedprice"]["quantiles"][0]).count() / df.count()
    assert abs(rank - 0.1) < 0.01
    assert found["l_returnflag"]["quantiles"] is None


def test_sketches_are_kept_with_copies(spark, root):
    tables = {("s", n): spark.range(i * 100, i * 100 + 200) for i, n in enumerate("ab c")}
    snapshot_full(FrameTables(spark, tables), root, "x", DAYS[0], options=SnapshotOptions(sketches=True))
    kept = copy_sketches(spark, read_manifest(spark, root))
    assert rows(kept.select("table_name", "row_count")) == [(" ", 200), ("a", 200), ("b", 200), ("c", 200)]
    found = estimates(merged(kept), [0.5]).first()
    assert found["row_count"] == 800 and abs(found["distinct_count"] - 500) <= 15
    assert rows(spark.read.parquet(read_manifest(spark, root).first()["path"]))
