"""Queries on the artifact catalogue: listing, newest, retention, chains, storage."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablekeep.functions import naming, sizes, times
from tablekeep.operators import catalogue, retention, validate
from tablekeep.plans.commit_log import CommitLog
from tablekeep.plans.manifest import MANIFEST
from tablekeep.plans.rotation import rotate_files as rotate
from tablekeep.queries.common import (
    ARTIFACTS_SQL,
    CHAIN_AS_OF,
    RETENTION_AS_OF,
    artifacts,
    readable_sql,
    table,
)
from tablekeep.session import scratch_folder
from tablekeep.sources import artifacts as stored, files
from tablekeep.sources.copy_text import read_copy_text, write_copy_text
from tablekeep.sources.members import member_lines, write_members

TIE = "event_id"


def _listing_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A listing line per event; some kinds of event give lines that are none."""
    events = table(spark, folder, "events")
    size = F.round(F.col("value") * 100).cast("bigint").cast("string")
    return events.select(
        "event_id",
        F.when(F.col("value") < 1, F.lit("   "))
        .when(
            F.col("value") < 2,
            F.concat(F.lit("                           PRE "), F.col("event_type"), F.lit("/")),
        )
        .when(
            F.col("value") < 3,
            F.concat(F.date_format("ts", "yyyy-13-dd HH:mm:ss"), F.lit(" 7 no_month.sql")),
        )
        .otherwise(
            F.concat(
                F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
                F.lpad(size, 11, " "),
                F.lit(" "),
                F.col("event_type"),
                F.lit(" "),
                F.col("event_id"),
                F.lit(".sql.gz"),
            )
        )
        .alias("line"),
    )


_LINES_SQL = """WITH lines AS (
  SELECT event_id, CASE
    WHEN value < 1 THEN '   '
    WHEN value < 2 THEN concat('                           PRE ', event_type, '/')
    WHEN value < 3 THEN concat(strftime(ts, '%Y-13-%d %H:%M:%S'), ' 7 no_month.sql')
    ELSE concat(strftime(ts, '%Y-%m-%d %H:%M:%S'),
                lpad(CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR), 11, ' '), ' ',
                event_type, ' ', event_id, '.sql.gz') END AS line
  FROM events
), parsed AS (
  SELECT *, regexp_extract(line, p, 3) AS n,
         try_strptime(regexp_extract(line, p, 1), '%Y-%m-%d %H:%M:%S') AS seen_at,
         TRY_CAST(regexp_extract(line, p, 2) AS BIGINT) AS size
  FROM (SELECT *, '^(\\d{4}-\\d\\d-\\d\\d \\d\\d:\\d\\d:\\d\\d)\\s+(\\d+)\\s+(\\S.*)$' AS p
        FROM lines)
), outcomes AS (
  SELECT *, CASE WHEN n <> '' AND seen_at IS NOT NULL AND size IS NOT NULL THEN 'parsed'
                 WHEN trim(line) = '' THEN 'blank' ELSE 'malformed' END AS outcome
  FROM parsed
)"""


def artifact_listing(spark: SparkSession, folder: str) -> DataFrame:
    return stored.listed_artifacts(_listing_lines(spark, folder))


def artifact_listing_report(spark: SparkSession, folder: str) -> DataFrame:
    return stored.listing_report(_listing_lines(spark, folder))


def artifact_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation texts as whole listings, cut into lines and fields."""
    texts = table(spark, folder, "conversations").select(F.col("text").alias("listing"))
    return (
        stored.lines_of(texts)
        .groupBy("line")
        .agg(F.count(F.lit(1)).alias("times"))
    )


def artifact_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names, times and sizes of every artifact through the scalar functions."""
    at, table_name = F.col("modified_at"), naming.qualified(F.lit("public"), F.col("table_name"))
    path = F.concat(F.lit("s3a://bucket/backups/"), naming.backup_name(at))
    as_of = times.moment(RETENTION_AS_OF)
    return artifacts(spark, folder).select(
        TIE,
        times.stamp(at).alias("stamp"),
        times.day_stamp(at).alias("day"),
        naming.backup_name(at).alias("backup_name"),
        naming.backup_name_for_day(at).alias("day_name"),
        naming.schema_backup_name(F.col("table_name"), at).alias("schema_name"),
        naming.incremental_name(table_name, at).alias("incremental_name"),
        naming.base_name(path).alias("base_name"),
        naming.without_extension(naming.base_name(path)).alias("stem"),
        naming.or_default(F.nullif(F.col("kind"), F.lit("full")), "none").alias("kind_or_none"),
        times.epoch_seconds(at).alias("epoch"),
        times.from_epoch(times.epoch_seconds(at)).alias("to_the_second"),
        times.parse_listing_time(F.substring(at.cast("string"), 1, 19)).alias("parsed"),
        times.age_seconds(at, as_of).alias("age_seconds"),
        times.age_days(at, as_of).alias("age_days"),
        sizes.in_unit(F.col("size_bytes"), "KB").alias("size_kb"),
        sizes.readable(F.col("size_bytes") * 1000003).alias("size"),
    )


_NAMES_SQL = f"""{ARTIFACTS_SQL}
SELECT event_id,
  strftime(modified_at, '%Y%m%d_%H%M%S') AS stamp,
  strftime(modified_at, '%Y%m%d') AS day,
  'backup_' || strftime(modified_at, '%Y%m%d_%H%M%S') || '.sql.gz' AS backup_name,
  'backup_' || strftime(modified_at, '%Y%m%d') || '.sql.gz' AS day_name,
  table_name || '_' || strftime(modified_at, '%Y%m%d') || '.sql.gz' AS schema_name,
  'incremental_public_' || table_name || '_' || strftime(modified_at, '%Y%m%d') || '.sql.gz'
    AS incremental_name,
  'backup_' || strftime(modified_at, '%Y%m%d_%H%M%S') || '.sql.gz' AS base_name,
  'backup_' || strftime(modified_at, '%Y%m%d_%H%M%S') || '.sql' AS stem,
  CASE WHEN kind = 'full' THEN 'none' ELSE kind END AS kind_or_none,
  CAST(epoch_us(modified_at) // 1000000 AS BIGINT) AS epoch,
  date_trunc('second', modified_at) AS to_the_second,
  date_trunc('second', modified_at) AS parsed,
  (epoch_us(TIMESTAMP '2024-02-15') - epoch_us(modified_at)) // 1000000 AS age_seconds,
  (epoch_us(TIMESTAMP '2024-02-15') - epoch_us(modified_at)) // 86400000000 AS age_days,
  concat(((size_bytes * 200 + 1024) // 2048) // 100, '.',
         lpad(CAST(((size_bytes * 200 + 1024) // 2048) % 100 AS VARCHAR), 2, '0')) AS size_kb,
  {readable_sql('(size_bytes * 1000003)')} AS size
FROM art"""


def artifact_list(spark: SparkSession, folder: str) -> DataFrame:
    return catalogue.artifact_list(artifacts(spark, folder), TIE)


def artifact_list_by_name(spark: SparkSession, folder: str) -> DataFrame:
    return catalogue.artifact_list(artifacts(spark, folder), by="name")


def latest_artifact(spark: SparkSession, folder: str) -> DataFrame:
    return catalogue.latest_artifact(artifacts(spark, folder), TIE)


def latest_by_name(spark: SparkSession, folder: str) -> DataFrame:
    return catalogue.latest_by_name(artifacts(spark, folder))


def latest_per_table(spark: SparkSession, folder: str) -> DataFrame:
    return catalogue.latest_per_table(artifacts(spark, folder), TIE)


def find_by_name(spark: SparkSession, folder: str) -> DataFrame:
    return catalogue.find_by_name(artifacts(spark, folder), "20240115_1", TIE)


def find_by_date(spark: SparkSession, folder: str) -> DataFrame:
    return catalogue.find_by_date(artifacts(spark, folder), "2024-01-17", TIE)


def find_by_day_name(spark: SparkSession, folder: str) -> DataFrame:
    """The newest artifact with the exact name of a day, where names carry days only."""
    named = artifacts(spark, folder).withColumn(
        "name", naming.backup_name_for_day(F.col("modified_at"))
    )
    return catalogue.find_by_date(named, "2024-01-17", TIE, exact_name=True)


def _retention(rule: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return retention.retention(artifacts(spark, folder), RETENTION_AS_OF, 30, rule)

    return query


def _retention_sql(expired: str) -> str:
    return f"""{ARTIFACTS_SQL}, aged AS (
  SELECT *, (epoch_us(TIMESTAMP '2024-02-15') - epoch_us(modified_at)) // 1000000 AS age_seconds
  FROM art
)
SELECT *, age_seconds // 86400 AS age_days, {expired} AS expired FROM aged"""


def retention_plan(spark: SparkSession, folder: str) -> DataFrame:
    return retention.retention_plan(artifacts(spark, folder), RETENTION_AS_OF, 18, "exact", TIE)


_PLAN_SQL = f"""{ARTIFACTS_SQL}, aged AS (
  SELECT *, (epoch_us(TIMESTAMP '2024-02-15') - epoch_us(modified_at)) // 1000000 AS age_seconds,
         modified_at < TIMESTAMP '2024-02-15' - INTERVAL 18 DAY AS expired,
         max(CASE WHEN kind = 'full' THEN event_id END) OVER w AS base_id,
         row_number() OVER (PARTITION BY table_name ORDER BY modified_at DESC, event_id DESC) AS nr,
         row_number() OVER (PARTITION BY table_name, kind
                            ORDER BY modified_at DESC, event_id DESC) AS nr_of_kind
  FROM art
  WINDOW w AS (PARTITION BY table_name ORDER BY modified_at, event_id ROWS UNBOUNDED PRECEDING)
), bases AS (
  SELECT DISTINCT base_id FROM aged WHERE kind = 'incremental' AND NOT expired
), planned AS (
  SELECT table_name, name, modified_at, size_bytes, kind, event_id, age_seconds,
         age_seconds // 86400 AS age_days, expired,
         expired AND (nr = 1 OR (kind = 'full' AND nr_of_kind = 1)
                      OR event_id IN (SELECT base_id FROM bases WHERE base_id IS NOT NULL))
           AS needed
  FROM aged
)
SELECT *, expired AND NOT needed AS removable FROM planned"""


def restore_chain(spark: SparkSession, folder: str) -> DataFrame:
    return catalogue.restore_chain(artifacts(spark, folder), CHAIN_AS_OF, TIE)


_CHAIN_SQL = f"""{ARTIFACTS_SQL}, until AS (
  SELECT *, max(CASE WHEN kind = 'full' THEN modified_at END) OVER (PARTITION BY table_name) AS base
  FROM art WHERE modified_at <= TIMESTAMP '2024-01-20'
)
SELECT * EXCLUDE (base),
       row_number() OVER (PARTITION BY table_name ORDER BY modified_at, event_id) AS step
FROM until WHERE modified_at >= base"""


def restore_chain_whole(spark: SparkSession, folder: str) -> DataFrame:
    """One long chain per user: the first event of each is taken as the full copy."""
    events = table(spark, folder, "events")
    first = events.groupBy("user_id").agg(F.min("event_id").alias("event_id"), F.lit("full").alias("first"))
    users = events.join(first, ["user_id", "event_id"], "left").select(
        F.concat(F.lit("user_"), F.col("user_id")).alias("table_name"),
        F.coalesce("first", F.lit("incremental")).alias("kind"),
        F.col("ts").alias("modified_at"),
        "event_id",
    )
    return catalogue.restore_chain(users, "2024-01-25 00:00:00", TIE)


_WHOLE_CHAIN_SQL = """
SELECT concat('user_', user_id) AS table_name,
       CASE WHEN event_id = min(event_id) OVER (PARTITION BY user_id) THEN 'full'
            ELSE 'incremental' END AS kind,
       ts AS modified_at, event_id,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step
FROM events WHERE ts <= TIMESTAMP '2024-01-25'
"""


def restore_points(spark: SparkSession, folder: str) -> DataFrame:
    return catalogue.restore_points(artifacts(spark, folder), CHAIN_AS_OF, TIE)


def storage_usage(spark: SparkSession, folder: str) -> DataFrame:
    return catalogue.storage_usage(artifacts(spark, folder))


def _dump_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Dump text per event type and day; few lines hold a marker."""
    events = table(spark, folder, "events")
    return events.select(
        F.concat(F.col("event_type"), F.lit("_"), times.day_stamp(F.col("ts"))).alias("artifact"),
        F.when(F.col("value") > 200, F.concat(F.lit("CREATE TABLE t"), F.col("user_id")))
        .when((F.col("value") >= 150) & (F.col("value") < 170), F.lit("COPY t FROM stdin;"))
        .otherwise(F.col("props"))
        .alias("value"),
    )


def validate_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """Dumps written as compressed text, one folder each, then listed, read and checked."""
    root = scratch_folder(spark, "dumps")
    # Few files per artifact; Spark splits the lines of a large one and joins small ones.
    dumps = _dump_lines(spark, folder).hint("rebalance", "artifact")
    dumps.write.partitionBy("artifact").option("compression", "gzip").text(root)
    found = stored.list_files(spark, root, "*.gz", recursive=True)
    of_path = F.regexp_extract("path", "artifact=([^/]+)/", 1)
    listing = found.select(of_path.alias("artifact")).distinct()
    lines = stored.dump_lines(spark, root, "*.gz", recursive=True).withColumn("artifact", of_path)
    return validate.validate_artifacts(listing, lines, "artifact")


_VALIDATE_SQL = """
SELECT concat(event_type, '_', strftime(ts, '%Y%m%d')) AS artifact,
       bool_or(value > 200) AS has_schema,
       bool_or(value >= 150 AND value < 170) AS has_data,
       bool_or(value > 200) AND bool_or(value >= 150 AND value < 170) AS valid
FROM events GROUP BY 1
"""


def _dump_files(spark: SparkSession, folder: str, label: str) -> str:
    """A folder of plain dump files, one for each event type and day, as old as that day's noon."""
    root = scratch_folder(spark, label)
    dumps = _dump_lines(spark, folder).repartition(_parts(spark), "artifact")
    dumps.write.partitionBy("artifact").text(root)
    for name, *_, path in stored.list_files(spark, root, "part-*", recursive=True).toLocalIterator():
        day = datetime.strptime(path.rsplit("/", 2)[1][-8:], "%Y%m%d")
        files.set_modified(spark, path, int((day - datetime(1970, 1, 1)).total_seconds() + 43200) * 1000)
    return root


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _by_artifact(listed: DataFrame) -> DataFrame:
    of_path = F.regexp_extract("path", "artifact=([^/]+)/", 1)
    return listed.groupBy(of_path.alias("artifact")).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("size_bytes").alias("size_bytes"),
        F.max("modified_at").alias("modified_at"),
    )


def artifact_files(spark: SparkSession, folder: str) -> DataFrame:
    """Dump files listed by tasks, folder by folder, from a time on."""
    root = _dump_files(spark, folder, "listed")
    listed = stored.list_files(spark, root, "part-*", recursive=True)
    return _by_artifact(listed.where("modified_at >= TIMESTAMP_NTZ '2024-01-10 00:00:00'"))


def rotate_files(spark: SparkSession, folder: str) -> DataFrame:
    """What rotation by the files' own age leaves of all dump files."""
    root = _dump_files(spark, folder, "rotated-files")
    gone = rotate(spark, root, RETENTION_AS_OF, "part-*", 30, "exact", recursive=True)
    left = stored.list_files(spark, root, "part-*", recursive=True)
    return _by_artifact(left.join(gone, "path", "left_anti"))


_FILES_SQL = """
SELECT concat(event_type, '_', strftime(ts, '%Y%m%d')) AS artifact, CAST(1 AS BIGINT) AS files,
       CAST(sum(1 + strlen(CASE WHEN value > 200 THEN concat('CREATE TABLE t', user_id)
                                WHEN value >= 150 AND value < 170 THEN 'COPY t FROM stdin;'
                                ELSE props END)) AS BIGINT) AS size_bytes,
       date_trunc('day', min(ts)) + INTERVAL 12 HOUR AS modified_at
FROM events GROUP BY 1"""


def retention_tie(spark: SparkSession, folder: str) -> DataFrame:
    """The plan where all artifacts of a day are of one time, told apart by their ids."""
    same = artifacts(spark, folder).withColumn("modified_at", F.date_trunc("day", "modified_at").cast("timestamp_ntz"))
    return retention.retention_plan(same, RETENTION_AS_OF, 18, "exact", TIE)


def manifest_commits(spark: SparkSession, folder: str) -> DataFrame:
    """A manifest of one commit per customer, read from its last checkpoint and what came after."""
    root = scratch_folder(spark, "commits")
    log = CommitLog(spark, f"{root}/manifest", MANIFEST, every=100)
    key = F.col("c_custkey")
    log.append_each(
        table(spark, folder, "customer").select(
            F.concat(F.lit("s"), F.coalesce(F.col("c_nationkey").cast("string"), F.lit(""))).alias("snapshot_id"),
            F.lpad(key.cast("string"), 12, "0").alias("run_id"),
            F.concat(F.lit("t"), key).alias("table_name"),
            key.alias("row_count"),
            F.lit("full").alias("kind"),
            F.when(F.col("c_acctbal") < 0, "failed").otherwise("ok").alias("status"),
        )
    )
    return log.read().groupBy("snapshot_id", "status").agg(
        F.count(F.lit(1)).alias("commits"),
        F.sum("row_count").alias("row_count"),
        F.max("run_id").alias("newest"),
    )


_COMMITS_SQL = """
SELECT concat('s', c_nationkey) AS snapshot_id,
       CASE WHEN c_acctbal < 0 THEN 'failed' ELSE 'ok' END AS status, count(*) AS commits,
       CAST(sum(c_custkey) AS BIGINT) AS row_count,
       lpad(CAST(max(c_custkey) AS VARCHAR), 12, '0') AS newest
FROM customer GROUP BY ALL
"""


def dump_members(spark: SparkSession, folder: str) -> DataFrame:
    """The documents' lines written as one gzip file by many tasks and read back by many, counted."""
    root = scratch_folder(spark, "members")
    documents = table(spark, folder, "documents")
    lines = documents.select(F.explode(F.split("text", "\n")).alias("value"))
    write_members(lines, root, member_bytes=1 << 16, one_file=True)
    return member_lines(spark, root).groupBy("value").agg(F.count(F.lit(1)).alias("times"))


_MEMBERS_SQL = """
SELECT value, count(*) AS times
FROM (SELECT unnest(string_split(text, chr(10))) AS value FROM documents) GROUP BY value
"""


def _copy_text(name: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        """A table written as COPY text and read back, each member beginning inside a block."""
        root = scratch_folder(spark, f"copy-text-{name}")
        rows = table(spark, folder, name)
        write_copy_text(rows, root, "sales", name, member_bytes=1 << 16)
        return read_copy_text(spark, root, "sales", name, rows.schema)

    return query


def validate_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every document looked through whole for two words, by source; all sources listed."""
    documents = table(spark, folder, "documents")
    return validate.validate_artifacts(
        documents.select("source").distinct(),
        documents,
        key="source",
        text="text",
        schema_marker="Apache License, Version 2.0",
        data_marker="worthless",
    )


_TIE_SQL = _PLAN_SQL.replace(
    ARTIFACTS_SQL, ARTIFACTS_SQL.replace("ts AS modified_at", "date_trunc('day', ts) AS modified_at")
)
_VALIDATE_TEXTS_SQL = """
SELECT source,
       coalesce(bool_or(contains(text, 'Apache License, Version 2.0')), FALSE) AS has_schema,
       coalesce(bool_or(contains(text, 'worthless')), FALSE) AS has_data,
       coalesce(bool_or(contains(text, 'Apache License, Version 2.0')), FALSE)
         AND coalesce(bool_or(contains(text, 'worthless')), FALSE) AS valid
FROM documents GROUP BY source
"""

QUERIES = {
    "artifact_listing": (
        artifact_listing,
        f"{_LINES_SQL} SELECT n AS name, seen_at AS modified_at, size AS size_bytes"
        " FROM outcomes WHERE outcome = 'parsed'",
    ),
    "artifact_listing_report": (
        artifact_listing_report,
        f"{_LINES_SQL} SELECT outcome, count(*) AS lines FROM outcomes GROUP BY outcome",
    ),
    "artifact_lines": (
        artifact_lines,
        "SELECT line, count(*) AS times FROM"
        " (SELECT unnest(string_split(trim(text, E' \\t\\n\\r\\x0b\\x0c'), chr(10))) AS line FROM conversations)"
        " GROUP BY line",
    ),
    "artifact_names": (artifact_names, _NAMES_SQL),
    "artifact_list": (
        artifact_list,
        f"{ARTIFACTS_SQL} SELECT *, {readable_sql('size_bytes')} AS size FROM art"
        " ORDER BY modified_at DESC, event_id DESC",
    ),
    "artifact_list_by_name": (
        artifact_list_by_name,
        f"{ARTIFACTS_SQL} SELECT *, {readable_sql('size_bytes')} AS size FROM art ORDER BY name",
    ),
    "latest_artifact": (
        latest_artifact,
        f"{ARTIFACTS_SQL} SELECT * FROM art ORDER BY modified_at DESC, event_id DESC LIMIT 1",
    ),
    "latest_by_name": (
        latest_by_name,
        f"{ARTIFACTS_SQL} SELECT * FROM art WHERE name = (SELECT max(name) FROM art)",
    ),
    "latest_per_table": (
        latest_per_table,
        f"{ARTIFACTS_SQL} SELECT * FROM art QUALIFY row_number() OVER"
        " (PARTITION BY table_name ORDER BY modified_at DESC, event_id DESC) = 1",
    ),
    "find_by_name": (
        find_by_name,
        f"{ARTIFACTS_SQL} SELECT * FROM art WHERE contains(name, '20240115_1')"
        " ORDER BY modified_at DESC, event_id DESC LIMIT 1",
    ),
    "find_by_date": (
        find_by_date,
        f"{ARTIFACTS_SQL} SELECT * FROM art WHERE CAST(modified_at AS DATE) = DATE '2024-01-17'"
        " ORDER BY modified_at DESC, event_id DESC LIMIT 1",
    ),
    "find_by_day_name": (
        find_by_day_name,
        f"{ARTIFACTS_SQL} SELECT * REPLACE ('backup_20240117.sql.gz' AS name) FROM art"
        " WHERE strftime(modified_at, '%Y%m%d') = '20240117'"
        " ORDER BY modified_at DESC, event_id DESC LIMIT 1",
    ),
    "retention_exact": (
        _retention("exact"),
        _retention_sql("modified_at < TIMESTAMP '2024-02-15' - INTERVAL 30 DAY"),
    ),
    "retention_seconds": (_retention("seconds"), _retention_sql("age_seconds > 30 * 86400")),
    "retention_whole_days": (
        _retention("whole_days"),
        _retention_sql("age_seconds // 86400 > 30"),
    ),
    "retention_plan": (retention_plan, _PLAN_SQL),
    "restore_chain": (restore_chain, _CHAIN_SQL),
    "restore_chain_whole": (restore_chain_whole, _WHOLE_CHAIN_SQL),
    "restore_points": (
        restore_points,
        f"{ARTIFACTS_SQL} SELECT * FROM art WHERE modified_at <= TIMESTAMP '2024-01-20'"
        " QUALIFY row_number() OVER"
        " (PARTITION BY table_name ORDER BY modified_at DESC, event_id DESC) = 1"
        " AND bool_or(kind = 'full') OVER (PARTITION BY table_name)",
    ),
    "storage_usage": (
        storage_usage,
        f"{ARTIFACTS_SQL} SELECT *, {readable_sql('size_bytes')} AS size FROM ("
        " SELECT table_name, kind, count(*) AS artifacts,"
        " CAST(sum(size_bytes) AS BIGINT) AS size_bytes,"
        " CAST(grouping_id(table_name, kind) AS INTEGER) AS level"
        " FROM art GROUP BY ROLLUP (table_name, kind))",
    ),
    "validate_artifacts": (validate_artifacts, _VALIDATE_SQL),
    "artifact_files": (
        artifact_files,
        f"SELECT * FROM ({_FILES_SQL}) WHERE modified_at >= TIMESTAMP '2024-01-10'",
    ),
    "rotate_files": (
        rotate_files,
        f"SELECT * FROM ({_FILES_SQL}) WHERE modified_at >= TIMESTAMP '2024-02-15' - INTERVAL 30 DAY",
    ),
    "dump_members": (dump_members, _MEMBERS_SQL),
    **{
        f"copy_text_{name}": (_copy_text(name), f"SELECT * FROM {name}")
        for name in ("documents", "events", "orders", "conversations", "lineitem")
    },
    "retention_tie": (retention_tie, _TIE_SQL),
    "manifest_commits": (manifest_commits, _COMMITS_SQL),
    "validate_texts": (validate_texts, _VALIDATE_TEXTS_SQL),
}
