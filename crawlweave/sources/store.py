"""Versioned Parquet snapshots of several tables, published together by an exclusive create."""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Tables of one version are written side by side; threads are kept, as each has its own connection to the JVM.
_WRITERS = ThreadPoolExecutor(4, "crawlweave-store")


class Conflict(RuntimeError):
    """Another writer has published this version."""


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._schemas: dict[str, StructType] = {}
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The latest published version; 0 if there is none."""
        at = self._path(f"{self.folder}/manifests")
        return max((int(f.getPath().getName()) for f in self._fs.listStatus(at)), default=0) if self._fs.exists(at) else 0

    def manifest(self, version: int | None = None) -> dict[str, str]:
        stream = self._fs.open(self._path(f"{self.folder}/manifests/{version or self.version()}"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def read(self, table: str, version: int | None = None) -> DataFrame:
        path = self.manifest(version)[table]
        if path not in self._schemas:
            self._schemas[path] = self.spark.read.parquet(path).schema  # a job; tables never change once they are written
        return self.spark.read.schema(self._schemas[path]).parquet(path)

    def commit(self, tables: dict[str, DataFrame], expected: int) -> int:
        """Writes tables as the version after `expected`; tables that are not given stay. Only one writer can publish a version."""
        if self.version() != expected:
            raise Conflict(f"version {self.version()}, not {expected}")
        new = {name: f"{self.folder}/{name}/{uuid.uuid4().hex}" for name in tables}
        paths = (self.manifest(expected) if expected else {}) | new
        write = inheritable_thread_target(self.spark)(lambda name: tables[name].write.parquet(new[name]))
        list(_WRITERS.map(write, tables))
        self._schemas |= {path: tables[name].schema for name, path in new.items()}
        self._publish(expected + 1, paths)
        return expected + 1

    def _publish(self, version: int, paths: dict[str, str]) -> None:
        """The manifest is written aside and renamed, so readers see it whole or not at all; a name that is taken is never replaced."""
        target, aside = self._path(f"{self.folder}/manifests/{version}"), self._path(f"{self.folder}/aside/{uuid.uuid4().hex}")
        self._fs.mkdirs(target.getParent())
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(paths).encode()))
        out.close()
        try:
            if self._fs.exists(target):
                raise Conflict(f"version {version} is published")
            context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
            none = self.spark.sparkContext._gateway.new_array(getattr(self.spark._jvm.org.apache.hadoop.fs.Options, "Rename"), 0)
            context.rename(aside, target, none)  # fails if the target is there
        except Conflict:
            raise
        except Exception as e:
            raise Conflict(f"version {version} is published") from e
        finally:
            self._fs.delete(aside, False)

    def drop_versions(self, keep: int = 3) -> int:
        """Deletes all but the last versions and the tables that only they name; how many tables went."""
        last = self.version()
        kept = [self.manifest(v) for v in range(max(1, last - keep + 1), last + 1)]
        live = {p for m in kept for p in m.values()}
        gone = set()
        for v in range(1, max(1, last - keep + 1)):
            at = self._path(f"{self.folder}/manifests/{v}")
            if self._fs.exists(at):
                gone |= set(self.manifest(v).values()) - live
                self._fs.delete(at, False)
        for p in gone:
            self._fs.delete(self._path(p), True)
        return len(gone)
