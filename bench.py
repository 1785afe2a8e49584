"""Headline timings; prints one JSON line.

``BENCH_SF_DIR`` names the folder of tables, ``BENCH_CPUS`` the cores. Each query
runs once untimed (JVM warm-up, file cache) and then twice; the mean of those
counts. Every result is written to a sink that drops it, so all of it is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablekeep.queries import ALL  # noqa: E402
from tablekeep.queries.common import RETENTION_AS_OF, TABLES, artifacts, source, table  # noqa: E402
from tablekeep.operators.profile import table_fingerprints  # noqa: E402
from tablekeep.operators.retention import retention_plan  # noqa: E402
from tablekeep.plans.snapshot import snapshot_full, snapshot_incremental  # noqa: E402
from tablekeep.queries.snapshots import DAY_1, DAY_2, snapshot_parallel  # noqa: E402
from tablekeep.session import local_session, scratch_folder  # noqa: E402
from tablekeep.sources import files  # noqa: E402

REGISTERED = [
    "snapshot_full",
    "snapshot_restore_lineitem",
    "snapshot_text_restore_lineitem",
    "snapshot_incremental",
    "validate_snapshot",
    "changed_tables",
    "restore_as_of_after",
    "restore_guarded_force",
    "table_profile",
    "table_fingerprint",
    "row_delta",
    "row_delta_documents",
    "changed_since",
    "artifact_listing",
    "latest_per_table",
    "restore_chain_whole",
    "storage_usage",
    "validate_artifacts",
    "incremental_stream",
]


def native_fingerprints(spark, folder):
    return table_fingerprints({name: table(spark, folder, name) for name in TABLES})


def unchanged_incremental(spark, folder, root):
    """An incremental snapshot of tables whose files did not change."""
    return snapshot_incremental(source(spark, folder), root, "next", DAY_2)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "tablekeep-bench")
    spark.sparkContext.setLogLevel("ERROR")

    work = {name: ALL[name][0] for name in REGISTERED}
    for parallelism in (1, 2, 4):
        work[f"snapshot_parallel_{parallelism}"] = (
            lambda s, f, n=parallelism: snapshot_parallel(s, f, n)
        )
    work["table_fingerprint_native"] = native_fingerprints
    work["retention_plan"] = lambda s, f: retention_plan(
        artifacts(s, f), RETENTION_AS_OF, 18, "exact", "event_id"
    )
    base = scratch_folder(spark, "bench-base")
    snapshot_full(source(spark, folder), base, "base", DAY_1)
    work["snapshot_incremental_unchanged"] = lambda s, f: unchanged_incremental(s, f, base)

    seconds = {}
    for name, query in work.items():
        times = []
        for _ in range(3):
            start = time.perf_counter()
            query(spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.mean(times[1:]), 3)

    megabytes = sum(files.size_bytes(spark, f"{folder}/{n}.parquet") for n in TABLES) / 1e6
    print(
        json.dumps(
            {
                "metric": "sum of mean query times",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder).removeprefix("sf"),
                "cpus": int(cores) if cores.isdigit() else cores,
                "snapshot_full_mb_per_sec": round(megabytes / seconds["snapshot_full"], 1),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
