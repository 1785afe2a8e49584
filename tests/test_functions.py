from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tablekeep.functions import listing, naming, sizes, times
from tablekeep.sources.artifacts import lines_of, listed_artifacts, listing_report, parse_listing

AS_OF = datetime(2024, 6, 15, 12)
LISTING = [
    "2024-03-15 12:00:00     123456 backup_20240315_120000.sql.gz",
    "2024-02-01 00:00:00         99 sales_20240201.sql.gz",
    "",
    "bad line",
    "                           PRE sub/",
    "2024-02-30 00:00:00         99 no_such_day.sql.gz",
    "2024-02-01 00:00:00         99 name with blanks.sql",
]


@pytest.mark.parametrize(
    "age, exact, seconds, whole_days",
    [
        (timedelta(days=30), False, False, False),
        (timedelta(days=30, microseconds=1), True, False, False),
        (timedelta(days=30, seconds=1), True, True, False),
        (timedelta(days=31, seconds=-1), True, True, False),
        (timedelta(days=31), True, True, True),
        (timedelta(days=-1), False, False, False),
    ],
)
def test_retention_boundaries(spark, age, exact, seconds, whole_days):
    df = spark.createDataFrame([(AS_OF - age,)], "at timestamp_ntz")
    found = df.select(
        *[times.expired(F.col("at"), AS_OF, 30, rule).alias(rule) for rule in times.RULES]
    ).first()
    assert tuple(found) == (exact, seconds, whole_days)


def test_retention_reaches_the_scan(spark, data):
    df = spark.read.parquet(f"{data}/events.parquet")
    plan = df.where(times.expired(F.col("ts"), "2024-02-15", 30, "whole_days"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(ts,2024-01-15T00:00)" in text


def test_unknown_rule():
    with pytest.raises(ValueError):
        times.expired(F.lit(None), AS_OF, 30, "monthly")


def test_ages_round_down(spark):
    df = spark.createDataFrame([(AS_OF + timedelta(seconds=1),)], "at timestamp_ntz")
    now = times.moment(AS_OF)
    found = df.select(times.age_days(F.col("at"), now), times.age_seconds(F.col("at"), now))
    assert tuple(found.first()) == (-1, -1)


def test_moments(spark):
    found = spark.range(1).select(
        times.moment(date(2024, 3, 1)), times.moment("2024-03-01 00:00:00")
    )
    assert set(found.first()) == {datetime(2024, 3, 1)}


def test_clock_changes_of_the_session_zone_do_not_matter(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    gap = datetime(2024, 3, 10, 2, 30, 0, 123456)  # an hour New York left out
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.createDataFrame([(gap,)], "at timestamp_ntz")
        at = F.col("at")
        found = df.select(
            times.stamp(at),
            times.day_stamp(at),
            times.epoch_seconds(at),
            times.epoch_micros(at),
            times.from_epoch(times.epoch_seconds(at)),
            times.parse_listing_time(F.lit("2024-03-10 02:30:00")),
            times.age_seconds(at, times.moment("2024-03-11 02:30:00")),
            times.epoch_seconds(times.moment("1969-12-31 23:59:59.5")),
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    whole = gap.replace(microsecond=0)
    assert tuple(found) == (
        "20240310_023000",
        "20240310",
        1710037800,
        1710037800123456,
        whole,
        whole,
        86399,
        -1,
    )


@pytest.mark.parametrize("text", ["2024-03-10", "2024-02-30 00:00:00", "x", "", None, "2024-3-1 1:2:3"])
def test_other_texts_are_no_times(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(times.parse_listing_time(F.col("t"))).first()[0] is None


def test_names(spark):
    at = times.moment("2024-03-15 12:00:00")
    table = naming.qualified(F.lit("sales"), F.lit("orders"))
    found = spark.range(1).select(
        naming.backup_name(at),
        naming.backup_name(at, ".sql"),
        naming.backup_name_for_day(at),
        naming.schema_backup_name(F.lit("sales"), at),
        naming.incremental_name(table, at),
        naming.base_name(F.lit("s3a://b/backups/x.tar.gz")),
        naming.without_extension(F.lit("x.tar.gz")),
        naming.without_extension(F.lit("plain")),
        naming.without_extension(F.lit(".profile")),
        naming.or_default(F.lit(""), "4"),
        naming.or_default(F.lit(None).cast("string"), "4"),
        naming.or_default(F.lit("8"), "4"),
        naming.qualified(F.lit(None).cast("string"), F.lit("t")),
    )
    assert tuple(found.first()) == (
        "backup_20240315_120000.sql.gz",
        "backup_20240315_120000.sql",
        "backup_20240315.sql.gz",
        "sales_20240315.sql.gz",
        "incremental_sales_orders_20240315.sql.gz",
        "x.tar.gz",
        "x.tar",
        "plain",
        ".profile",
        "4",
        "4",
        "8",
        None,
    )


@pytest.mark.parametrize(
    "size, text",
    [
        (0, "0 B"),
        (1023, "1023 B"),
        (1024, "1.00 KB"),
        (1536, "1.50 KB"),
        (1024 * 1024 - 1, "1024.00 KB"),
        (5 * 1024**3, "5.00 GB"),
        (2**63 - 1, "8192.00 PB"),
    ],
)
def test_readable_sizes(spark, size, text):
    df = spark.createDataFrame([(size,)], "n bigint")
    assert df.select(sizes.readable(F.col("n"))).first()[0] == text


def test_listing(spark):
    lines = spark.createDataFrame([(line,) for line in LISTING], "line string")
    found = sorted(tuple(r) for r in listed_artifacts(lines).collect())
    assert found == [
        ("backup_20240315_120000.sql.gz", datetime(2024, 3, 15, 12), 123456),
        ("name with blanks.sql", datetime(2024, 2, 1), 99),
        ("sales_20240201.sql.gz", datetime(2024, 2, 1), 99),
    ]
    report = {r["outcome"]: r["lines"] for r in listing_report(lines).collect()}
    assert report == {"parsed": 3, "blank": 1, "malformed": 3}
    assert parse_listing(lines).count() == len(LISTING)


def test_whole_listing_text(spark):
    text = spark.createDataFrame([("\n".join(LISTING),)], "listing string")
    assert lines_of(text).count() == len(LISTING)
    words = text.select(listing.fields(F.lit("  a  b\tc "))).first()[0]
    assert words == ["a", "b", "c"]
