"""Session defaults and lineage cuts."""

from __future__ import annotations

import atexit
import functools
import os
import re
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def local_session(cores: int | str = "*", app: str = "navstead") -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.driver.memory", os.environ.get("NAVSTEAD_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SCRATCH: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The application's folder below the one that the cluster names in ``spark.checkpoint.dir``.

    A session on one machine may name none and gets a throw-away folder.  A cluster must: executors
    would write to their own disks, and later reads would miss those files.  The folder goes with the
    application.
    """
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not named:
            if not re.match(r"local($|\[)", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="spark-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        _SCRATCH[app] = f"{named}/navstead-{app}"
        path = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH[app])
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return _SCRATCH[app]


class TableScope:
    """Tables that are written while it is open, to be dropped together once their reader's own result is written.

    Without a scope a table stays until the application ends.  Scopes nest; a table belongs to the
    innermost one of its thread.
    """

    _open = threading.local()

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __enter__(self) -> TableScope:
        self._open.stack = [*getattr(self._open, "stack", ()), self]
        return self

    def __exit__(self, *_: object) -> None:
        self._open.stack = self._open.stack[:-1]

    @classmethod
    def note(cls, path: str) -> str:
        """Put a path under the innermost open scope, if there is one."""
        stack = getattr(cls._open, "stack", ())
        if stack:
            stack[-1].paths.append(path)
        return path

    def drop(self) -> None:
        paths, self.paths = self.paths, []
        for path in paths:
            drop_folder(self.spark, path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system; an absent one is no error."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a stage boundary to the shared folder and read it back.

    Used where a result feeds several branches: it is computed once, survives lost executors,
    and keeps later plans short.  Parquet keeps column pruning and size statistics.
    """
    path = TableScope.note(f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_TABLES: dict[tuple[str, str, str], DataFrame] = {}


def stored(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A derived table written once per application and input folder."""

    @functools.wraps(build)
    def get(spark: SparkSession, source: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, source, f"{build.__module__}.{build.__qualname__}")
        if key not in _TABLES:
            with TableScope(spark):  # kept for the application, whatever scope the caller has open
                _TABLES[key] = cut_lineage(build(spark, source))
        return _TABLES[key]

    return get
