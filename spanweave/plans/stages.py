"""Runs of named stages that can be taken up again.

Each stage is a Parquet table in the run's folder. Its folder's name holds a digest of what it is made of: the files of its inputs (path, size, time of change), its
parameters and the stages it reads. A stage whose table is complete is read, not computed; one whose inputs or parameters changed, or that was
broken off, is computed anew, with all that follow from it. ``manifest.json`` lists the stages of the last run.

A digest is of the inputs, not of code: a changed function needs another ``version``.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _digest(*parts) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:20]


class Run:
    """``inputs``: a name and a path (file, folder or pattern) each; a missing input is an error. The folder is one that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, inputs: dict[str, str], version: str = "1"):
        self.spark, self.folder, self.inputs, self.version = spark, folder.rstrip("/"), inputs, version
        self.files = {name: self._listed(path) for name, path in inputs.items()}
        self.made: dict[str, str] = {}
        self.computed: list[str] = []
        self._digests: dict[str, str] = {}

    def _system(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self, path: str) -> list[tuple[str, int, int]]:
        at, system = self._system(path)
        found, out = system.globStatus(at), []
        for status in found or []:
            files = system.listFiles(status.getPath(), True)
            while files.hasNext():
                f = files.next()
                out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        if not out:
            raise FileNotFoundError(path)
        return sorted(out)

    def stage(self, name: str, make: Callable[..., DataFrame], reads: list[str] = (), inputs: list[str] = (), **parameters) -> DataFrame:
        """The table of ``make(*tables of the stages in reads, *paths of inputs, **parameters)``, computed only if it is not there yet."""
        if name in self.made:
            raise ValueError(f"two stages are named {name}")
        digest = _digest(name, self.version, [self._digests[r] for r in reads], [self.files[i] for i in inputs], parameters)
        path = f"{self.folder}/{name}-{digest}"
        self._digests[name], self.made[name] = digest, path
        at, system = self._system(path + "/_SUCCESS")
        if not system.exists(at):
            make(*[self.table(r) for r in reads], *[self.inputs[i] for i in inputs], **parameters).write.mode("overwrite").parquet(path)
            self.computed.append(name)
        self._note()
        return self.table(name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.made[name])

    def _note(self) -> None:
        at, system = self._system(f"{self.folder}/manifest.json")
        out = system.create(at, True)
        out.write(bytearray(json.dumps({"inputs": self.files, "stages": self.made}, indent=1).encode()))
        out.close()
