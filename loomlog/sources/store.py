"""Stored files: the manifest table, exports, what is kept in memory, and stopping work."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.config import service_id
from .catalog import MANIFEST


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names, which driver and executors share. Where that is unset on a
    single machine it becomes a folder of its own; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="loomlog-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/loomlog/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def save_manifest(manifest: DataFrame, path: str, version: int) -> None:
    """A manifest is a folder per version; a version without its _SUCCESS file does not count, so a save is whole or nothing."""
    manifest.write.mode("overwrite").parquet(f"{path}/version={version}")


def load_manifest(spark: SparkSession, path: str, below: int | None = None) -> tuple[DataFrame, int]:
    """The newest whole version (before `below`), and its number; without one an empty manifest and 0."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    versions = []
    if fs.exists(root):
        for s in fs.listStatus(root):
            name = s.getPath().getName()
            if name.startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
                versions.append(int(name[8:]))
    versions = [v for v in versions if below is None or v < below]
    if not versions:
        return spark.createDataFrame([], MANIFEST), 0
    return spark.read.schema(MANIFEST).parquet(f"{path}/version={max(versions)}"), max(versions)


def merge_manifest(manifest: DataFrame, changes: DataFrame, append: bool = False) -> DataFrame:
    """Changed keys take the place of old ones; with append, sizes add up and spans widen."""
    if not append:
        return manifest.join(changes.select("key"), "key", "left_anti").unionByName(changes)
    both = manifest.unionByName(changes)
    keep = [F.max(c).alias(c) for c in ("service_id", "file", "log_date", "instance")]
    return both.groupBy("key").agg(*keep, F.sum("size").alias("size"), F.max("mtime").alias("mtime"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def export_range(lines: DataFrame, files: DataFrame, folder: str, date_from: dt.date, date_to: dt.date) -> None:
    """Text of the dated files within range and of all undated ones, under folder/service=<id>/file=<name>, lines in order."""
    wanted = files.where(F.col("log_date").isNull() | F.col("log_date").between(F.lit(date_from), F.lit(date_to))).select("file_id", F.col("service_id").alias("service"), "file")
    rows = lines.join(wanted, "file_id").repartitionByRange("service", "file", "line_no").sortWithinPartitions("service", "file", "line_no")
    rows.select("service", "file", F.col("line").alias("value")).write.mode("overwrite").partitionBy("service", "file").text(folder)


def forget_service(environment: str, name: str, manifest: DataFrame) -> DataFrame:
    return manifest.where(F.col("service_id") != service_id(environment, name))


class MemoryTier:
    """DataFrames kept in executors' memory by version (files, sizes and times) while their bytes, as Spark has stored them,
    are within the limit; the least recently used ones go first. Those that a pass has pinned stay until it ends, whatever
    their size; what a pass has loaded and does not fit afterwards goes then."""

    def __init__(self, limit_bytes: int):
        self.limit, self.held, self.pins = limit_bytes, {}, {}

    @staticmethod
    def stored_bytes(df: DataFrame) -> int:
        """The size of a persisted table whose rows have been stored, else Spark's estimate for its plan."""
        return int(str(df._jdf.queryExecution().withCachedData().stats().sizeInBytes()))

    def get(self, version: tuple, make) -> DataFrame:
        """The table of the version; if it is not held, it is made and stored at once, as its size is needed."""
        if version in self.held:
            self.held[version] = self.held.pop(version)
        else:
            made = make().persist(StorageLevel.MEMORY_AND_DISK)
            made.count()
            self.held[version] = (made, self.stored_bytes(made))
            self._shrink()
        return self.held[version][0] if version in self.held else made

    @contextmanager
    def pinned(self, *versions: tuple):
        """Versions that a pass uses are not dropped inside, by whomever."""
        for v in versions:
            self.pins[v] = self.pins.get(v, 0) + 1
        try:
            yield self
        finally:
            for v in versions:
                self.pins[v] -= 1
                if not self.pins[v]:
                    del self.pins[v]
            self._shrink()

    def set_limit(self, limit_bytes: int) -> None:
        self.limit = limit_bytes
        self._shrink()

    def stats(self) -> dict:
        return {"tables": len(self.held), "bytes": sum(size for _, size in self.held.values()), "limit": self.limit, "pinned": len(self.pins.keys() & self.held.keys())}

    def _shrink(self) -> None:
        loose = [v for v in self.held if v not in self.pins]
        while loose and self.stats()["bytes"] > self.limit:
            self.held.pop(loose.pop(0))[0].unpersist()

    def clear(self) -> None:
        """Drop everything that is not pinned."""
        for v in [v for v in self.held if v not in self.pins]:
            self.held.pop(v)[0].unpersist()


@contextmanager
def cancellable(spark: SparkSession, tag: str):
    """Jobs inside can be stopped from another thread by cancel(spark, tag)."""
    spark.addTag(tag)
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)
        spark.removeTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    spark.sparkContext.cancelJobsWithTag(tag)


def is_cancelled(error: Exception) -> bool:
    """Whether a job ended because it was cancelled, rather than by a fault."""
    return "SPARK_JOB_CANCELLED" in str(error) or "cancelled" in str(error).lower()


@contextmanager
def counted(spark: SparkSession):
    """Observed counts inside are kept also where nothing is found: else Spark drops the plan below an empty step, and the
    counts with it."""
    key, rule = "spark.sql.adaptive.optimizer.excludedRules", "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"
    before = spark.conf.get(key, None)
    spark.conf.set(key, f"{before},{rule}" if before else rule)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
