"""Cutting lineage so that lost executors cost a re-read, not a recomputation."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: What :func:`durable` has written, by application, until :func:`sweep`.
_WRITTEN: dict[str, list[str]] = {}
#: Folders of our own, by application, where the setting is missing.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where that is unset, a folder of our own, on a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return _OWN[app]


def durable(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """``df`` computed once and read back from Parquet in the shared folder.

    Parquet rather than ``checkpoint()``: later readers take only the columns they need.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lorespark-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def delete_folders(spark: SparkSession, *paths: str) -> None:
    """Delete folders below the shared one."""
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files are deleted as soon as the query that wrote them ends, for steps that :func:`durable` cuts; otherwise they stay until the driver
    happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def release(*frames: DataFrame) -> None:
    """Delete what :func:`durable` wrote for these frames."""
    for df in frames:
        folders = {file.rsplit("/", 1)[0] for file in df.inputFiles()[:1]}
        delete_folders(df.sparkSession, *(f for f in folders if f.rsplit("/", 1)[-1].startswith("lorespark-")))


def sweep(spark: SparkSession) -> None:
    """Delete all that :func:`durable` has written in this application; for callers whose results are written."""
    delete_folders(spark, *_WRITTEN.pop(spark.sparkContext.applicationId, []))


def scratch_mark(spark: SparkSession) -> tuple[SparkSession, int]:
    """A point in time for :func:`release_since`."""
    return spark, len(_WRITTEN.get(spark.sparkContext.applicationId, []))


def release_since(mark: tuple[SparkSession, int], *kept: DataFrame) -> None:
    """Delete what :func:`durable` has written since ``mark``, but for the frames that are kept; for steps whose results are written."""
    spark, n = mark
    written = _WRITTEN.get(spark.sparkContext.applicationId, [])
    held = {name for df in kept for file in df.inputFiles() for name in file.split("/") if name.startswith("lorespark-")}
    gone = [p for p in written[n:] if p.rsplit("/", 1)[-1] not in held]
    written[n:] = [p for p in written[n:] if p not in gone]
    delete_folders(spark, *gone)
