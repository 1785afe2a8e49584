import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from tablekeep.operators import catalogue, change, profile, retention, selection
from tests.conftest import rows

AS_OF = datetime(2024, 6, 1)
ARTIFACT = "name string, table_name string, kind string, modified_at timestamp_ntz, size_bytes bigint"


def art(spark, entries):
    return spark.createDataFrame(entries, ARTIFACT)


def random_artifacts(seed, tables=4, n=120):
    """Artifacts with many equal times; one table has most of them."""
    draw = random.Random(seed)
    return [
        (
            f"n{i:04d}",
            "t0" if draw.random() < 0.5 else f"t{draw.randrange(tables)}",
            "full" if draw.random() < 0.25 else "incremental",
            AS_OF - timedelta(hours=draw.randrange(80) * 12),
            draw.randrange(1000),
        )
        for i in range(n)
    ]


# selection


def test_selection(spark):
    tables = spark.createDataFrame(
        [
            ("public", "orders"),
            ("public", "events"),
            ("pg_catalog", "x"),
            ("information_schema", "y"),
            ("sales", "region"),
            (None, "z"),
        ],
        "schema_name string, table_name string",
    )

    def names(**options):
        found = selection.select_tables(tables, **options).collect()
        return sorted(r["qualified_name"] for r in found)

    assert names() == ["public.events", "public.orders", "sales.region"]
    assert names(only="orders, region") == ["public.orders", "sales.region"]
    assert names(only=["public.orders"]) == ["public.orders"]
    assert names(schemas="public", exclude="orders") == ["public.events"]
    assert names(schemas="public", exclude_schemas="public") == []
    assert names(only="") == ["public.events", "public.orders", "sales.region"]
    assert rows(selection.count_by_schema(selection.select_tables(tables))) == [
        ("public", 2),
        ("sales", 1),
    ]


# change


def test_changed_since_is_strict_and_null_safe(spark):
    day = lambda d: datetime(2024, 1, d)
    stats = spark.createDataFrame(
        [
            ("s", "a", None, day(12)),
            ("s", "b", None, None),
            ("s", "c", None, day(9)),
            ("s", "d", day(10), day(10)),
            ("s", "e", day(11), None),
        ],
        "schema_name string, table_name string, last_analyze timestamp_ntz,"
        " last_autoanalyze timestamp_ntz",
    )
    found = change.changed_since(stats, day(10))
    assert sorted(r["qualified_name"] for r in found.collect()) == ["s.a", "s.e"]


@pytest.mark.parametrize("method", ["content", "digest"])
@pytest.mark.parametrize("seed", range(3))
def test_row_delta_against_brute_force(spark, seed, method):
    draw = random.Random(seed)

    def bag():
        return [
            (draw.choice([1, 2, None]), draw.choice(["a", "", None]), draw.choice([[1], [], None]))
            for _ in range(60)
        ]

    old, new = bag(), bag()
    ddl = "i int, s string, a array<int>"
    found = change.row_delta(
        spark.createDataFrame(old, ddl).repartition(3), spark.createDataFrame(new, ddl), method
    )
    count = lambda rows_: Counter(repr(r) for r in rows_)
    gone, come = count(old) - count(new), count(new) - count(old)
    expected = [("deleted", n, r) for r, n in gone.items()] + [
        ("inserted", n, r) for r, n in come.items()
    ]
    assert sorted((r[0], r[1], repr(tuple(r[2:]))) for r in found.collect()) == sorted(expected)


def test_row_delta_counts_copies_and_nulls(spark):
    old = spark.createDataFrame([(1, None), (1, None), (2, "b"), (3, "c")], "i int, s string")
    new = spark.createDataFrame([(1, None), (3, "c"), (3, "c"), (3, "c"), (2, None)], "i int, s string")
    assert rows(change.row_delta(old, new)) == [
        ("deleted", 1, 1, None),
        ("deleted", 1, 2, "b"),
        ("inserted", 1, 2, None),
        ("inserted", 2, 3, "c"),
    ]
    assert change.row_delta(old, old.repartition(3)).isEmpty()
    with pytest.raises(ValueError):
        change.row_delta(old, old.drop("s"))


def test_row_delta_shuffles_once(spark, data):
    df = spark.read.parquet(f"{data}/lineitem.parquet")
    plan = change.row_delta(df, df.where("l_tax > 0"), "content")._jdf.queryExecution().executedPlan()
    assert plan.toString().count("Exchange ") == 1


# profile


@pytest.mark.parametrize("distinct", ["approx", "exact"])
def test_profile(spark, distinct):
    df = spark.createDataFrame(
        [(1, "a", None, [1]), (2**62, None, 1.5, None), (2**62, "b", 2.5, [1])],
        "i bigint, s string, d double, a array<int>",
    )
    found = {r["column_name"]: r.asDict() for r in profile.table_profile(df, distinct).collect()}
    assert found["i"]["sum_number"] == float(2**63 + 1)
    assert found["i"]["distinct_count"] == 2
    assert (found["s"]["non_null"], found["s"]["min_text"], found["s"]["max_text"]) == (2, "a", "b")
    assert (found["d"]["sum_number"], found["d"]["distinct_count"]) == (4.0, 2)
    assert (found["a"]["row_count"], found["a"]["non_null"], found["a"]["distinct_count"]) == (3, 2, 1)


def test_profile_of_odd_column_names(spark):
    names = ["a.b", "it's", "c`d", "{x}", "back\\slash", "__rows2"]
    df = spark.createDataFrame([tuple(range(6))], ", ".join("`" + n.replace("`", "``") + "` int" for n in names))
    for distinct in ("approx", "exact"):
        assert sorted(r["column_name"] for r in profile.table_profile(df, distinct).collect()) == sorted(names)


def test_profile_is_exact_and_one_pass(spark, root):
    big = 2**53 + 1
    df = spark.createDataFrame([(big, True, None), (big, False, "x")], "n long, b boolean, s string")
    found = {r["column_name"]: r for r in profile.table_profile(df, "exact").collect()}
    assert (found["n"]["max_text"], found["n"]["sum_text"]) == (str(big), str(2 * big))
    assert (found["b"]["min_text"], found["b"]["distinct_count"], found["s"]["distinct_count"]) == (
        "false", 2, 1,
    )
    odd = spark.sql("SELECT parse_json('1') AS v, map(1, 2) AS m, X'01' AS b")
    for distinct in ("approx", "exact", "none"):
        assert profile.table_profile(odd, distinct).count() == 3
    df.write.parquet(f"{root}/t")
    stored = spark.read.parquet(f"{root}/t")
    for distinct in ("approx", "none"):
        plan = profile.table_profile(stored, distinct)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1


def test_profile_of_no_rows(spark):
    df = spark.createDataFrame([], "i int, s string")
    for distinct in ("approx", "exact", "none"):
        found = profile.table_profile(df, distinct).collect()
        assert [(r["row_count"], r["non_null"]) for r in found] == [(0, 0), (0, 0)]


# catalogue


def test_ties_go_to_the_later_name(spark):
    same = datetime(2024, 1, 1)
    df = art(spark, [("b", "t", "full", same, 1), ("c", "t", "full", same, 1), ("a", "t", "full", same, 1)])
    assert catalogue.latest_artifact(df).first()["name"] == "c"
    assert catalogue.latest_per_table(df).first()["name"] == "c"
    assert [r["name"] for r in catalogue.artifact_list(df).collect()] == ["c", "b", "a"]


def test_nothing_found(spark):
    df = art(spark, [("backup_20240101.sql.gz", "t", "full", datetime(2024, 1, 1), 1)])
    with pytest.raises(catalogue.NoArtifactError):
        catalogue.find_by_name(df, "x")
    with pytest.raises(catalogue.NoArtifactError):
        catalogue.find_by_date(df, "2024-01-02")
    with pytest.raises(catalogue.NoArtifactError):
        catalogue.find_by_date(df, "2024-01-02", exact_name=True)
    with pytest.raises(catalogue.NoArtifactError):
        catalogue.required(catalogue.latest_artifact(df.where("false")), "empty")
    assert catalogue.find_by_date(df, "2024-01-01", exact_name=True).count() == 1


def chains(entries, as_of):
    found = {}
    for table in {e[1] for e in entries}:
        until = sorted((e for e in entries if e[1] == table and e[3] <= as_of), key=lambda e: (e[3], e[0]))
        fulls = [i for i, e in enumerate(until) if e[2] == "full"]
        if fulls:
            found[table] = [e[0] for e in until[fulls[-1] :]]
    return found


@pytest.mark.parametrize("seed", range(5))
def test_chain_and_points_against_brute_force(spark, seed):
    entries = random_artifacts(seed)
    as_of = AS_OF - timedelta(days=7)
    expected = chains(entries, as_of)
    df = art(spark, entries).repartition(5)
    found = {}
    for r in sorted(catalogue.restore_chain(df, as_of).collect(), key=lambda r: r["step"]):
        found.setdefault(r["table_name"], []).append((r["step"], r["name"]))
    assert found == {t: list(enumerate(names, 1)) for t, names in expected.items()}
    points = {r["table_name"]: r["name"] for r in catalogue.restore_points(df, as_of).collect()}
    assert points == {t: names[-1] for t, names in expected.items()}


def test_long_chain_is_numbered_without_gaps(spark):
    entries = [("n00000", "t", "full", AS_OF, 1)] + [
        (f"n{i:05d}", "t", "incremental", AS_OF + timedelta(minutes=7 * i), 1) for i in range(1, 500)
    ]
    chain = catalogue.restore_chain(art(spark, entries), AS_OF + timedelta(days=90)).orderBy("step")
    assert [(r["step"], r["name"]) for r in chain.collect()] == [
        (i + 1, e[0]) for i, e in enumerate(entries)
    ]


# retention


def brute_force_plan(entries, as_of, days):
    cutoff = as_of - timedelta(days=days)
    needed = set()
    for table in {e[1] for e in entries}:
        own = sorted((e for e in entries if e[1] == table), key=lambda e: (e[3], e[0]))
        needed.add(own[-1][0])
        fulls = [e for e in own if e[2] == "full"]
        if fulls:
            needed.add(fulls[-1][0])
        for e in own:
            if e[2] != "full" and not e[3] < cutoff:
                before = [f for f in fulls if (f[3], f[0]) <= (e[3], e[0])]
                if before:
                    needed.add(before[-1][0])
    return {e[0] for e in entries if e[3] < cutoff and e[0] not in needed}


@pytest.mark.parametrize("seed", range(8))
def test_retention_plan_against_brute_force(spark, seed):
    entries = random_artifacts(seed, n=80)
    days = (seed * 6) % 45
    plan = retention.retention_plan(art(spark, entries).repartition(3), AS_OF, days)
    assert plan.count() == len(entries)
    found = {r["name"] for r in plan.where("removable").collect()}
    assert found == brute_force_plan(entries, AS_OF, days)


def test_a_restore_reads_the_same_after_retention(spark):
    for seed, days in ((99, 10), (7, 0), (8, 60)):
        df = art(spark, random_artifacts(seed))
        plan = retention.retention_plan(df, AS_OF, days)
        kept = plan.where("NOT removable").select(*df.columns)
        before, after = (catalogue.restore_points(x, AS_OF) for x in (df, kept))
        assert rows(after) == rows(before)
