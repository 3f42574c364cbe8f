"""Intermediate tables in the folder that all executors share.

The cluster names that folder in ``spark.checkpoint.dir``. Only where the
setting is absent and the master is local (tests) a temporary folder of this machine is used;
a cluster without the setting is an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_COLLECTING: list[list[Scratch]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; set for this session only if it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spanweave-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_LOCAL[app])
    return _LOCAL[app]


class Scratch:
    """Named Parquet tables of one operator call. Writing one cuts its lineage: a lost
    executor costs a re-read of shared files, never a recomputation of earlier steps."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        for opened in _COLLECTING:
            opened.append(self)

    def save(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(partition_by)
        # the table replaces the shuffles that led to it; their files would otherwise stay on the
        # executors' disks until the driver's garbage collector finds them
        cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(cleanup, "false")
        self.spark.conf.set(cleanup, "true")
        try:
            writer.parquet(path)
        finally:
            self.spark.conf.set(cleanup, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *saved: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for df in saved:
            self._delete(df._scratch_path)

    def remove(self) -> None:
        """Delete all tables: the results that read them have been written."""
        self._delete(self.root)

    def _delete(self, where: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def collecting(opened: list[Scratch]) -> Iterator[None]:
    """Within this context every new Scratch is also appended to ``opened``, for its owner to remove."""
    _COLLECTING.append(opened)
    try:
        yield
    finally:
        _COLLECTING.remove(opened)
