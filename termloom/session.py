"""Session settings the jobs expect, and the shared folder they may write to."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings, all public Spark ones. Cluster deployments set their own memory,
# parallelism and ``spark.checkpoint.dir``.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}

METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
TASK_BYTES = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A ``local[cpus]`` session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("termloom")
    settings = {**SETTINGS, "spark.sql.shuffle.partitions": str(shuffle_partitions), **extra}
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir`` that every executor can reach.

    Only a session whose master is known to be ``local`` or ``local[...]`` may
    go without that setting; it then gets one temporary folder of this machine,
    which is removed when the Python process ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or _local_root(spark)
    path = os.path.join(root, "termloom", f"{purpose}-{uuid.uuid4().hex}")
    for held in _working:
        held.append(path)
    return path


@contextmanager
def working_folders(spark: SparkSession) -> Iterator[None]:
    """What ``shared_folder`` names inside of this block is removed at its end, also after a failure.

    For jobs that have written their result by then: frames that still read such a folder cannot be used afterwards.
    """
    held: list[str] = []
    _working.append(held)
    try:
        yield
    finally:
        _working.remove(held)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for name in held:
            path = hadoop(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def compiled_methods(spark: SparkSession) -> Iterator[None]:
    """Writes inside of this block fuse operators only where the JVM compiles the method that this makes.

    Rows of thirty text columns easily make a longer one, which the JVM would interpret for every row.
    """
    before = spark.conf.get(METHOD_LIMIT)
    spark.conf.set(METHOD_LIMIT, "8000")
    try:
        yield
    finally:
        spark.conf.set(METHOD_LIMIT, before)


@contextmanager
def smaller_tasks(spark: SparkSession) -> Iterator[None]:
    """Writes inside of this block give a task half of what Spark would, as it counts packed bytes.

    Wide rows in the order of their key pack to a twentieth and less, so a task of the usual size would sort more of them than its
    memory holds, in files. A size that the session sets itself is left alone.
    """
    own = spark.conf.get(TASK_BYTES, None) is None
    if own:
        spark.conf.set(TASK_BYTES, "32m")
    try:
        yield
    finally:
        if own:
            spark.conf.unset(TASK_BYTES)


_working: list[list[str]] = []


def _local_root(spark: SparkSession) -> str:
    global _own_root
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    if _own_root is None:
        _own_root = tempfile.TemporaryDirectory(prefix="termloom-")
    return _own_root.name


_own_root: tempfile.TemporaryDirectory | None = None


def stored(df: DataFrame, purpose: str, **options: int | str) -> DataFrame:
    """The frame written to the shared folder and read back: computed once, and of known size.

    ``options`` are those of the Parquet writer.
    """
    path = shared_folder(df.sparkSession, purpose)
    with compiled_methods(df.sparkSession):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
