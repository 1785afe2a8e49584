"""Time expressions.

"Now" is always an argument, so results are repeatable. Times have no zone and
none is put between, so results do not depend on the session's time zone.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, functions as F

# The shape of times in listings, the epoch, the seconds in a day
# and the days an artifact is kept when nothing else is said. Artifact names
# carry times as yyyymmdd_hhmmss or yyyymmdd.
LISTING_TIME = r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$"
EPOCH = "1970-01-01 00:00:00"
SECONDS_PER_DAY = 86400
DEFAULT_RETENTION_DAYS = 30

RULES = ("exact", "seconds", "whole_days")


def moment(value: datetime | date | str | Column) -> Column:
    """A ``timestamp_ntz`` from a Python value, ISO text or a column."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if isinstance(value, datetime):
        value = value.replace(tzinfo=None).isoformat(sep=" ")
    elif isinstance(value, date):
        value = value.isoformat()
    return F.lit(value).cast("timestamp_ntz")


def stamp(value: Column) -> Column:
    """``20240315_120000``."""
    text = F.substring(value.cast("timestamp_ntz").cast("string"), 1, 19)
    return F.translate(text, " -:", "_")


def day_stamp(value: Column) -> Column:
    """``20240315``."""
    return F.translate(F.substring(value.cast("string"), 1, 10), "-", "")


def parse_listing_time(text: Column) -> Column:
    """Timestamp from ``yyyy-mm-dd hh:mm:ss``, NULL for any other text or no such time."""
    return F.when(text.rlike(LISTING_TIME), text.try_cast("timestamp_ntz"))


def _elapsed(start: Column, end: Column) -> Column:
    """Seconds from one time to another with six decimals, with no time zone between."""
    span = end.cast("timestamp_ntz") - start.cast("timestamp_ntz")
    return span.cast("interval second").cast("decimal(20,6)")


def epoch_seconds(value: Column) -> Column:
    """Full seconds since the epoch of a time without zone."""
    return F.floor(_elapsed(F.lit(EPOCH), value)).cast("bigint")


def epoch_micros(value: Column) -> Column:
    """Microseconds since the epoch of a time without zone."""
    return (_elapsed(F.lit(EPOCH), value) * F.lit(1_000_000)).cast("bigint")


def epoch_micros_sql(value: str) -> str:
    """:func:`epoch_micros` of a value given as SQL."""
    span = f"CAST({value} AS TIMESTAMP_NTZ) - CAST('{EPOCH}' AS TIMESTAMP_NTZ)"
    return f"CAST(CAST(CAST({span} AS INTERVAL SECOND) AS DECIMAL(20, 6)) * 1000000 AS BIGINT)"


def from_epoch(seconds: Column) -> Column:
    return F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def age_seconds(value: Column, as_of: Column) -> Column:
    """Full seconds from ``value`` to ``as_of``, rounded down."""
    return F.floor(_elapsed(value, as_of)).cast("bigint")


def age_days(value: Column, as_of: Column) -> Column:
    """Full days from ``value`` to ``as_of``, rounded down."""
    return F.floor(age_seconds(value, as_of) / F.lit(SECONDS_PER_DAY)).cast("bigint")


def expired(value: Column, as_of: datetime | str, days: int, rule: str = "exact") -> Column:
    """Whether ``value`` is out of retention.

    Every rule comes down to comparing the bare column with a constant, which
    a file scan can push down:

    - ``exact``: older than ``days`` to the microsecond;
    - ``seconds``: more than ``days`` * 86400 full seconds old;
    - ``whole_days``: more than ``days`` full days old, so first at ``days`` + 1.
    """
    if days < 0:
        raise ValueError("days must not be negative")
    now = moment(as_of)
    if rule == "exact":
        return value < now - F.lit(timedelta(days=days))
    if rule == "seconds":
        return value <= now - F.lit(timedelta(days=days, seconds=1))
    if rule == "whole_days":
        return value <= now - F.lit(timedelta(days=days + 1))
    raise ValueError(f"unknown retention rule {rule!r}; one of {RULES}")
