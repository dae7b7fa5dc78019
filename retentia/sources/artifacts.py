"""Versions of a fitted model: folders of stages and tables, and a pointer to the one in use.

A version is written below ``versions`` under a name of its own.  Readers see
it only once it is published, which is the creation of one empty file below
``pointers``; its name holds a number and the version.  The highest number
counts.  Creating a file either happens or doesn't, so readers never meet a
half-written version, a failed fit leaves the version in use as it is, and going
back is publishing an older version again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Version:
    spark: SparkSession
    name: str
    folder: str

    def path(self, part: str) -> str:
        return f"{self.folder}/{part}"

    def write(self, rows: DataFrame, part: str) -> DataFrame:
        """Stores a table of the version and reads it back."""
        rows.write.parquet(self.path(part))
        return self.table(part)

    def table(self, part: str) -> DataFrame:
        return self.spark.read.parquet(self.path(part))

    def save(self, model: PipelineModel, part: str) -> None:
        model.write().save(self.path(part))

    def model(self, part: str) -> PipelineModel:
        return PipelineModel.load(self.path(part))


class ArtifactStore:
    """Versions below one folder, in any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _version(self, name: str) -> Version:
        return Version(self.spark, name, f"{self.root}/versions/{name}")

    def begin(self) -> Version:
        """A new version to write into; nobody sees it yet."""
        return self._version(uuid.uuid4().hex)

    def published(self) -> list[str]:
        """Names of the versions in the order of their publication."""
        folder = self._path(f"{self.root}/pointers")
        if not self._files.exists(folder):
            return []
        pointers = sorted(f.getPath().getName() for f in self._files.listStatus(folder))
        return [p.split("-", 1)[1] for p in pointers]

    def publish(self, version: Version) -> None:
        """Makes a version the one in use; of two at the same time, both are published and one is the later."""
        if not self._files.exists(self._path(version.folder)):
            raise ValueError(f"version {version.name} has no content")
        number = len(self.published()) + 1
        pointer = self._path(f"{self.root}/pointers/{number:08d}-{version.name}")
        if not self._files.createNewFile(pointer):
            raise RuntimeError(f"{pointer} exists")

    def current(self) -> Version:
        names = self.published()
        if not names:
            raise LookupError(f"{self.root} has no published version")
        return self._version(names[-1])

    def discard_old(self, keep: int = 2) -> list[str]:
        """Deletes versions published before the last ``keep`` and used by none of them."""
        names = self.published()
        kept = set(names[-keep:])
        gone = sorted({n for n in names if n not in kept})
        for name in gone:
            self._files.delete(self._path(f"{self.root}/versions/{name}"), True)
        return gone
