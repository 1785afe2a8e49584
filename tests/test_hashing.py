from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tablekeep.functions.hashing import portable_row_hash, row_hash
from tablekeep.operators.profile import fingerprint
from tablekeep.plans.copies import measure, read_copy, write_copy


def print_of(df, algorithm="native"):
    return tuple(fingerprint(df, algorithm).first())


def test_order_and_partitioning_do_not_matter(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    assert print_of(df) == print_of(df.orderBy(F.desc("doc_id")).repartition(7))


@pytest.mark.parametrize("algorithm", ["native", "portable"])
def test_one_value_and_one_copy_matter(spark, algorithm):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "i int, s string")
    other = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "i int, s string")
    twice = df.unionAll(df.where("i = 1"))
    none_left = df.where("i = 1")  # a pair of equal rows must not cancel out
    found = {print_of(x, algorithm) for x in (df, other, twice, none_left)}
    assert len(found) == 4
    assert len({f for _, f in found}) == 4


@pytest.mark.parametrize("algorithm", ["native", "portable"])
def test_position_of_null_matters(spark, algorithm):
    left = spark.createDataFrame([("a", None)], "a string, b string")
    right = spark.createDataFrame([(None, "a")], "a string, b string")
    assert print_of(left, algorithm) != print_of(right, algorithm)


def test_boundaries_between_texts_matter_in_the_portable_form(spark):
    left = spark.createDataFrame([("a:1", "b")], "a string, b string")
    right = spark.createDataFrame([("a", "1:b")], "a string, b string")
    assert print_of(left, "portable") != print_of(right, "portable")


@pytest.mark.parametrize(
    "ddl, left, right",
    [
        ("a array<int>", ([1, None],), ([None, 1],)),
        ("a array<int>", ([],), (None,)),
        ("a array<int>", ([None],), ([],)),
        ("a array<int>, b array<int>", ([1], [2, 3]), ([1, 2], [3])),
        ("a array<array<int>>", ([[1], [2]],), ([[1, 2]],)),
        ("a array<array<int>>", ([[1], []],), ([[1], None],)),
        ("a struct<x:int,y:int>", ((1, None),), ((None, 1),)),
        ("a struct<x:int,y:int>", ((None, None),), (None,)),
        ("a map<string,int>", ({"k": 1},), ({"k": 2},)),
        ("a map<string,int>", ({"k": None},), ({},)),
        ("a map<string,array<int>>", ({"k": [1, None]},), ({"k": [None, 1]},)),
        ("a boolean", (True,), (False,)),
        ("a decimal(10,2)", (Decimal("1.10"),), (Decimal("1.11"),)),
        ("a binary", (b"\x00",), (b"\x01",)),
        ("a double", (float("nan"),), (None,)),
    ],
)
def test_values_that_look_alike_hash_apart(spark, ddl, left, right):
    one, two = spark.createDataFrame([left], ddl), spark.createDataFrame([right], ddl)
    assert print_of(one) != print_of(two)


def test_entry_order_of_a_map_does_not_matter(spark):
    one = spark.sql("SELECT map('a', 1, 'b', 2) AS m")
    two = spark.sql("SELECT map('b', 2, 'a', 1) AS m")
    assert print_of(one) == print_of(two)


def test_many_columns(spark):
    names = [f"c{i}" for i in range(150)]
    ddl = ", ".join(f"{n} int" for n in names)
    one = spark.createDataFrame([tuple(None if i == 70 else 1 for i in range(150))], ddl)
    two = spark.createDataFrame([tuple(None if i == 71 else 1 for i in range(150))], ddl)
    assert print_of(one) != print_of(two)


def test_column_names_with_dots_and_quotes(spark):
    df = spark.createDataFrame([(1, 2)], "`a.b` int, `c``d` int")
    assert fingerprint(df).first()["row_count"] == 1
    assert df.select(row_hash(df.schema)).first()[0] is not None


@pytest.mark.parametrize("format", ["parquet", "json"])
def test_a_copy_read_back_hashes_the_same(spark, root, data, format):
    for name in ("embeddings", "events", "conversations"):
        df = spark.read.parquet(f"{data}/{name}.parquet")
        written = write_copy(df, f"{root}/{name}", format)
        back = read_copy(spark, f"{root}/{name}", format, df.schema.json())
        assert written == measure(df) == measure(back)


def test_a_schema_without_nulls_hashes_the_same(spark, root):
    df = spark.range(3).select("id", F.array(F.lit(1), F.col("id").cast("int")).alias("a"))
    assert not df.schema["a"].dataType.containsNull
    written = write_copy(df, root)
    assert written == measure(spark.read.parquet(root))


@pytest.mark.parametrize("format", ["parquet", "json"])
def test_no_rows(spark, root, format):
    for i, df in enumerate(
        [
            spark.createDataFrame([], "a int, b array<string>"),
            spark.range(5).where("id < 0"),
            spark.range(5).where("false"),
        ]
    ):
        assert write_copy(df, f"{root}/{i}", format) == {"row_count": 0, "fingerprint": 0}
        back = read_copy(spark, f"{root}/{i}", format, df.schema.json())
        assert measure(back) == {"row_count": 0, "fingerprint": 0}


@pytest.mark.parametrize("shuffled", [False, True])
def test_rows_of_tasks_run_again_count_once(spark, root, shuffled):
    def lost_at_the_end(batches):
        from pyspark import TaskContext

        yield from batches
        task = TaskContext.get()
        if task.attemptNumber() == 0 and task.partitionId() % 2 == 0:
            raise RuntimeError("executor lost")

    df = spark.range(0, 10000, 1, 8).mapInPandas(lost_at_the_end, "id long")
    if shuffled:
        df = df.repartition(4, "id").mapInPandas(lost_at_the_end, "id long")
    written = write_copy(df, root)
    assert written == measure(spark.read.parquet(root)) == measure(spark.range(10000))


def test_a_write_counts_rows_once_behind_a_shuffle(spark, root):
    df = spark.range(1000).repartition(16).groupBy((F.col("id") % 7).alias("k")).count()
    assert write_copy(df, root)["row_count"] == 7


def test_portable_hash_sees_every_type(spark):
    base = dict(
        d="double(1.0)", f="float(2.5)", n="decimal(10,2)(3.25)", t="date'2024-01-01'",
        s="timestamp'2024-01-01 00:00:00'", b="X'01'", a="array(double(1), null)", x="true",
    )
    base["n"] = "CAST(3.25 AS decimal(10,2))"
    changed = dict(
        d="double(1.0000000000000002)", f="float(2.5000002)", n="CAST(3.26 AS decimal(10,2))",
        t="date'2024-01-02'", s="timestamp'2024-01-01 00:00:01'", b="X'02'",
        a="array(null, double(1))", x="false",
    )

    def mark(values):
        df = spark.sql("SELECT " + ", ".join(f"{v} AS {k}" for k, v in values.items()))
        return fingerprint(df, "portable").first()["fingerprint"]

    marks = {mark(base)} | {mark({**base, k: v}) for k, v in changed.items()}
    assert len(marks) == len(changed) + 1


def test_portable_doubles_keep_every_bit(spark):
    import math

    values = [0.0, 1.0, -1.5, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 0.1, 1 / 3,
              2.0**60, 2.0**61 + 512, 1e22, -1e-300, math.inf, -math.inf, math.nan]
    values += [math.nextafter(v, math.inf) for v in values if math.isfinite(v) and v < 1e308]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    hashes = {r[0] for r in df.select(portable_row_hash(df.schema)).collect()}
    assert len(hashes) == len(set(map(repr, values)))


def test_portable_hash_refuses_what_has_no_form(spark):
    df = spark.sql("SELECT 1 AS a, map(1, 2) AS m")
    with pytest.raises(ValueError, match="m"):
        fingerprint(df, "portable")
    assert fingerprint(df, "portable", ["a"]).first()["row_count"] == 1
