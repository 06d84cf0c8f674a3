"""Session settings, shared scratch space and input spreading."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(master: str = "local[*]", app_name: str = "maskwright", **settings: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Bodies may be large: a batch handed to Python is bounded by its bytes as well.
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(64 * 1024 * 1024))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_SCOPE: ContextVar[list[str] | None] = ContextVar("scratch_scope", default=None)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete at the end, also after an error, the scratch tables that were made inside.

    They may hold originals. A result that reads them has to be written or collected before the scope ends. Scopes may be
    nested; each deletes its own. Threads don't share a scope.
    """
    paths: list[str] = []
    outer = _SCOPE.set(paths)
    try:
        yield
    finally:
        _SCOPE.reset(outer)
        for path in paths:
            delete_folder(spark, path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store its path names; one that isn't there is no error."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one the cluster names in spark.checkpoint.dir; an open `scratch_scope` deletes it.

    Only a local session, as in tests, falls back to a folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = tempfile.mkdtemp(prefix="maskwright-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/maskwright/{name}-{uuid.uuid4().hex}"
    scope = _SCOPE.get()
    if scope is not None:
        scope.append(path)
    return path


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use every core on an input with fewer pieces than cores.

    A file with one row group is read by one task however many cores there are. A large table comes in more
    pieces than there are cores and is left where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, computed once into the shared scratch folder and read from there.

    For a result that several later steps need: they then read it, and a lost executor costs no earlier work. It
    stays until the `scratch_scope` around the call ends, or for whoever clears the folder if there is none.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
