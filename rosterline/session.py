"""Session settings and the shared folder that staged tables are written to."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

MOST_PARTITIONS = 200_000


def get_session(master: str | None = None, app_name: str = "rosterline", **conf) -> SparkSession:
    """A session with the settings the reports are tuned for, and any others the caller passes.

    A keyword's double underscores stand for dots: ``spark__sql__shuffle__partitions=64``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        # A report compiles some dozens of stages; keep them for the next run.
        "spark.sql.codegen.cache.maxEntries": "1000",
        # Recording the call site of every expression is half the time it takes to build a report.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update({key.replace("__", "."): str(value) for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or a folder in the warehouse if that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/staged-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def path_exists(spark: SparkSession, path: str) -> bool:
    system, place = _place(spark, path)
    return system.exists(place)


def data_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(location, bytes) of the files at a path or pattern, or in the folders there, but hidden ones."""
    system, place = _place(spark, path)
    out, found = [], list(system.globStatus(place) or [])
    while found:
        each = found.pop()
        if each.isDirectory():
            found += [inner for inner in system.listStatus(each.getPath()) if inner.getPath().getName()[0] not in "._"]
        else:
            out.append((each.getPath().toString(), each.getLen()))
    return sorted(out)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder; nothing happens if there is none."""
    system, place = _place(spark, path)
    system.delete(place, True)


def full_uri(spark: SparkSession, path: str) -> str:
    """The path with the file system that Spark would use for it."""
    system, place = _place(spark, path)
    return re.sub("^file:/+", "file:///", system.makeQualified(place).toUri().toString())


def size_shuffles(spark: SparkSession, *paths: str, bytes_per_partition: int = 8 << 20) -> int:
    """Raise the number of shuffle partitions to suit the files in the folders; returns the number.

    It is never lowered: adaptive execution merges partitions that turn out small. The files are columnar
    and compressed, so a partition of 8 MB of them may be hundreds of MB of wide rows in a sort.
    """
    total = 0
    for path in paths:
        system, place = _place(spark, path)
        total += system.getContentSummary(place).getLength()
    wanted = min(max(-(-total // bytes_per_partition), int(spark.conf.get("spark.sql.shuffle.partitions"))), MOST_PARTITIONS)
    spark.conf.set("spark.sql.shuffle.partitions", wanted)
    return wanted


def size_reads(spark: SparkSession, partitions: int) -> None:
    """Raise the number of tasks that read a large table; a few MB of columnar files may be hundreds of MB in a sort."""
    name = "spark.sql.files.minPartitionNum"
    if partitions > int(spark.conf.get(name, None) or 0):
        spark.conf.set(name, str(partitions))


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A setting of the session for the jobs that run in this block."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def workspace(spark: SparkSession) -> str:
    """Create a database whose tables live in the shared folder; returns its name."""
    name = f"staffing_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{fresh_path(spark, name)}'")
    return name
