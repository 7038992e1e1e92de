"""Session helpers: a tuned local session for tests, and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "panelspark", driver_memory: str = "8g") -> SparkSession:
    """A `local[N]` session for tests and the benchmark; clusters bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by `spark.checkpoint.dir`.

    Only a local master may fall back to a temporary folder: on a cluster an executor
    could not read what another one wrote there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="panelspark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_given: list[str] = []
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, one per call; `clear_scratch` removes it."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    _given.append(path)
    for scope in _scopes.get()[-1:]:
        scope.append(path)
    return path


@contextmanager
def own_scratch(spark: SparkSession) -> Iterator[None]:
    """What is written to scratch inside is removed at the end, but for what `handed_over` lets out."""
    paths: list[str] = []
    token = _scopes.set((*_scopes.get(), paths))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in paths:
            remove_path(spark, path)
            _given.remove(path)


def clear_scratch(spark: SparkSession) -> int:
    """Remove every scratch path given out by this process; returns how many. Results that still read one become unusable."""
    n = len(_given)
    while _given:
        remove_path(spark, _given.pop())
    return n


def checkpointed(df):
    """`df.checkpoint()` with the reliable checkpoint folder set first."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, whichever file system it is on."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Owned:
    """The latest table of a loop, in the shared folder: lineage ends there, and writing the next one removes the one before.

    `release` removes the last one too, which makes every DataFrame that reads it unusable.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.path = spark, name, None

    def write(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, self.name)
        df.write.parquet(path)
        self.release()
        self.path = path
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        if self.path:
            remove_path(self.spark, self.path)
            self.path = None


def handed_over(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again, for a plan that needs its rows more than once, or that outlives the
    scratch it was made of.

    What is read from it may be read any time, so it stays until `clear_scratch`, or to the end of the scope around.
    """
    token = _scopes.set(_scopes.get()[:-1])
    try:
        path = scratch_path(df.sparkSession, name)
    finally:
        _scopes.reset(token)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
