"""Session helpers: settings for a local session and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import SparkSession

from tablekeep.sources import files


def local_session(cores: str = "8", app: str = "tablekeep", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.scheduler.mode", "FAIR")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``.

    Only a local session may go without one; it then gets a temporary folder,
    kept as its checkpoint folder for later calls.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="tablekeep-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_scratch: list[str] = []


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, not used by any other run."""
    path = f"{shared_root(spark)}/tablekeep/{label}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def scratch_mark() -> int:
    """How many scratch folders are in use; to be given to :func:`release_scratch` later."""
    return len(_scratch)


def release_scratch(spark: SparkSession, since: int = 0, keep: Iterable[str] = ()) -> list[str]:
    """Delete the scratch folders this process was given, once no frame needs them any more: all of
    them, or those given since a mark, but for those to be kept."""
    gone, kept = [], set(keep)
    left = [path for path in _scratch[since:] if path in kept]
    for path in _scratch[since:]:
        if path not in kept:
            files.delete(spark, path)
            gone.append(path)
    _scratch[since:] = left
    return gone
