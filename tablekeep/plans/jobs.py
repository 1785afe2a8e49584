"""Several Spark jobs at once from one driver."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from queue import SimpleQueue
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


def run_jobs(
    spark: SparkSession,
    work: Callable[[Any], Any],
    items: Iterable[Any],
    parallelism: int,
) -> list[tuple[Any, Any, Exception | None]]:
    """``work(item)`` for every item, at most ``parallelism`` at a time.

    Returns (item, result, error) in the order of the items: one failure stops
    no other item. Each worker has a scheduler pool of its own, so that with
    ``spark.scheduler.mode=FAIR`` a large table does not hold up small ones.
    """
    if not isinstance(parallelism, int) or parallelism < 1:
        raise ValueError("parallelism must be a positive whole number")
    items = list(items)
    slots: SimpleQueue = SimpleQueue()
    for slot in range(parallelism):
        slots.put(slot)

    def run(item):
        slot = slots.get()
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"tablekeep-{slot}")
        try:
            return item, work(item), None
        except Exception as error:  # kept for the caller, item by item
            return item, None, error
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
            slots.put(slot)

    with ThreadPoolExecutor(max_workers=min(parallelism, max(len(items), 1))) as pool:
        start = inheritable_thread_target(spark)(run)
        futures = [pool.submit(start, item) for item in items]
        return [f.result() for f in futures]
