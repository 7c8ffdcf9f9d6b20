"""What every part needs from the session: the shared folder, shipped code, written tables, checked broadcasts."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a side of a join that may be broadcast, once they have been counted.
BROADCAST_BYTES = 8 << 20
#: Lets Spark delete a query's shuffle files as soon as its result is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only in local mode where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    global _own_folder
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="crawlweave-")
        atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
    return f"file://{_own_folder}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: the table is written to the shared folder and read again, so it survives lost executors. `dropped` deletes it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more; other DataFrames are left alone."""
    for df in tables:
        if path := df.__dict__.pop("written_at", None):
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def measured(df: DataFrame) -> tuple[int, int]:
    """Rows and about the bytes of a written table: fixed widths as they are, others by their lengths."""
    fixed, sums = 0, []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind in ("string", "binary"):
            sums.append(F.sum(F.octet_length(f.name)))
        elif kind.startswith("array"):
            sums.append(F.sum(F.size(f.name)) * (24 if "struct" in kind else 8))
        fixed += 8
    row = df.agg(F.count("*"), *sums).first()
    return row[0], row[0] * fixed + sum(max(0, x or 0) for x in row[1:])


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint if df, which should be a written table, is measured to have few enough bytes; else df, which is shuffled."""
    return F.broadcast(df) if measured(df)[1] <= most else df


def give_back() -> None:
    """Returns this process's freed memory to the system: Arrow's and, with glibc, the heap's."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, for mapInArrow, which gives freed memory back when its task ends: workers outlive tasks and would hold their largest one's memory."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def ship(spark: SparkSession) -> None:
    """Gives executors this package's code, for sessions whose workers do not see the repository."""
    sc = spark.sparkContext
    if getattr(sc, "_crawlweave_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="crawlweave-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "crawlweave.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(archive)
    sc._crawlweave_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
