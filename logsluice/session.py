"""Session defaults and the shared folder for checkpoints and written intermediates."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Streaming loads rely on REBALANCE, which only adaptive execution can split.
    "spark.sql.adaptive.streaming.stateless.enabled": "true",
    # Size reduce tasks for spilling rather than for the core count.
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
}


_at_end: list[tuple[SparkSession, Callable[[], object]]] = []


def at_end(spark: SparkSession, action: Callable[[], object]) -> None:
    """Do ``action`` when the process ends, if the session is still there by then."""
    _at_end.append((spark, action))


@atexit.register
def _end() -> None:
    for spark, action in reversed(_at_end):
        if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
            return
        action()


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder and what is in it, if it is there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def session(app: str = "logsluice", master: str | None = None, **conf: str) -> SparkSession:
    """A session with this package's defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temp folder only on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="logsluice-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, gone when the process ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    at_end(spark, lambda: remove_folder(spark, path))
    return path


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint()`` usable, keeping a folder that is already set."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Session settings for the length of a block; ``__`` stands for a dot."""
    wanted = {key.replace("__", "."): value for key, value in conf.items()}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def many_writers(spark: SparkSession):
    """Keep every shuffle partition a writer of its own.

    Adaptive execution merges tasks by bytes, but a partitioned write costs by files: a few
    megabytes may be thousands of small files, which one merged task would write one by one.
    """
    return settings(spark, spark__sql__adaptive__coalescePartitions__enabled="false")
