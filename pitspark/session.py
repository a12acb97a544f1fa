"""Session defaults, and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import copy_context
from functools import cache, partial
from threading import Lock
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.util import inheritable_thread_target

T = TypeVar("T")


def local_session(cores: str = "8", app: str = "pitspark") -> SparkSession:
    """A session for tests and the benchmark; on a cluster use the session it provides."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.driver.memory", "20g")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the session names in spark.checkpoint.dir. Only a local
    session that names none gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder()


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _writers, _before = Lock(), 0, None


@contextmanager
def _cleaning(spark: SparkSession):
    """Shuffle files go with the write that needed them. The setting is the session's, so it is set with the first
    of several writes at once and put back with the last."""
    global _writers, _before
    with _lock:
        if not _writers:
            _before = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _writers += 1
    try:
        yield
    finally:
        with _lock:
            _writers -= 1
            if not _writers:
                spark.conf.unset(CLEANUP) if _before is None else spark.conf.set(CLEANUP, _before)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write an intermediate table once and read it back. Its consumers start from files: they can
    prune columns, know the size, and a lost executor repeats none of the work behind them. The
    shuffle files behind the table are not needed after it, so Spark is told to remove them with it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with _cleaning(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` has written, once everything read from them is written itself."""
    for table in tables:
        spark = table.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(table._written_to)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def at_once(*steps: Callable[[], T]) -> list[T]:
    """Results of steps that don't need each other, run from as many threads: small writes share the cluster instead
    of waiting for each other, and plans are built while others are."""
    with ThreadPoolExecutor(max(1, len(steps))) as pool:
        return list(pool.map(lambda step: step(), [partial(copy_context().run, inheritable_thread_target(x)) for x in steps]))
