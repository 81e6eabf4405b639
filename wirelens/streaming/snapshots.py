"""A small table that every batch of a stream replaces as a whole.

A batch writes a version of its own and the write's last act marks it complete; readers take the newest complete
version, so they never meet a missing or half-written table. A batch that runs again after it was committed
changes nothing. Two versions are kept, so that a reader of the last but one can finish.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Snapshots:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _folder(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def versions(self) -> list[int]:
        """The batches whose versions are complete, oldest first."""
        path, system = self._folder()
        if not system.exists(path):
            return []
        found = []
        for entry in system.listStatus(path):
            name = re.fullmatch(r"version-(\d+)", entry.getPath().getName())
            if name and system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")):
                found.append(int(name[1]))
        return sorted(found)

    def read(self) -> DataFrame:
        """The newest complete version; without one a table without rows."""
        versions = self.versions()
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/version-{versions[-1]}")

    def commit(self, batch: int, rows: Callable[[DataFrame], DataFrame]) -> bool:
        """Write rows(the version before) as the version of a batch, unless this or a later batch is committed."""
        versions = self.versions()
        if versions and versions[-1] >= batch:
            return False
        rows(self.read()).write.mode("overwrite").parquet(f"{self.path}/version-{batch}")
        path, system = self._folder()
        for old in versions[:-1]:
            system.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path, f"version-{old}"), True)
        return True
