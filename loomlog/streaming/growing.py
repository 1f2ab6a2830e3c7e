"""Files that grow: read what was added, as a stream; store it by day, each byte once.

The source's offset holds, for each file, how many bytes were consumed and the last bytes before that place. If those are
still there, what follows is new; if not (the file was rotated), the file is read from its start, and lines not later than
the last stored one are dropped from its beginning.

What is stored of a file is its segments, one for each day, and the manifest has a row for each (key path#day). Each batch
merges its rows into the version before its own, so a batch that runs again changes nothing. Once a file's last segment
has been deleted, the file is new again: it is read from its start, and nothing is cut.
"""

from __future__ import annotations

import glob
import json
import os
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions.timestamps import parse
from ..operators.lines import fill_forward, split_lines
from ..sources.catalog import MANIFEST
from ..sources.store import load_manifest, merge_manifest, save_manifest, shared_path

TAIL = 2048


class Slice(InputPartition):
    def __init__(self, path: str, start: int, end: int, fresh: bool, again: bool, mtime: float):
        self.path, self.start, self.end, self.fresh, self.again, self.mtime = path, start, end, fresh, again, mtime


def _tail(path: str, end: int) -> str:
    with open(path, "rb") as f:
        f.seek(max(0, end - TAIL))
        return f.read(end - max(0, end - TAIL)).hex()


def _whole_lines(path: str, start: int, size: int) -> int:
    """End of the last complete line before size; a line still being written is left for later."""
    end = size
    with open(path, "rb") as f:
        while end > start:
            at = max(start, end - 65536)
            f.seek(at)
            cut = f.read(end - at).rfind(b"\n")
            if cut >= 0:
                return at + cut + 1
            end = at
    return start


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options):
        self.pattern, self.marks = options["path"], options.get("forgotten", "")
        self.seen = {}  # path: (size and time as listed, its last whole line's end, the bytes before it)

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        files, lives = {}, Counter()
        for name in glob.glob(f"{self.marks}/*.json") if self.marks else ():
            with open(name, encoding="utf-8") as f:
                lives.update(json.load(f))
        for path in sorted(glob.glob(self.pattern)):
            try:
                end, tail, mtime = self.look(path)
            except FileNotFoundError:  # since it was listed
                continue
            files[path] = {"size": end, "tail": tail, "life": lives[path], "mtime": mtime}
        self.seen = {path: self.seen[path] for path in files}
        return {"files": files}

    def look(self, path: str) -> tuple[int, str, float]:
        """Only files whose size or time has changed are opened; those that rest cost a listing."""
        now = os.stat(path)
        state = (now.st_size, now.st_mtime_ns, now.st_ino)
        held = self.seen.get(path)
        if held is None or held[0] != state:
            end = _whole_lines(path, 0, now.st_size)
            held = self.seen[path] = (state, end, _tail(path, end))
        return held[1], held[2], now.st_mtime

    def partitions(self, start: dict, end: dict):
        out = []
        for path, now in end["files"].items():
            before = start["files"].get(path)
            again = before is not None and before.get("life", 0) != now.get("life", 0)
            grown = before is not None and not again and now["size"] >= before["size"]
            if grown and now["size"] == before["size"]:
                grown = now["tail"] == before["tail"]
            elif grown:
                grown = _tail(path, before["size"]) == before["tail"]
            begin = before["size"] if grown else 0
            if now["size"] > begin:
                out.append(Slice(path, begin, now["size"], not grown, again, now.get("mtime", 0.0)))
        return out

    def read(self, partition: Slice) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            yield partition.path, partition.start, partition.fresh, partition.again, partition.mtime, f.read(partition.end - partition.start)

    def commit(self, end: dict) -> None:
        pass


class GrowingFiles(DataSource):
    """spark.readStream.format("growing_files").option("path", "/mount/*.log"): path, start, fresh, again, mtime, content of
    what was added, one task per file. fresh: read from its start; again: as it has been forgotten (option "forgotten": a folder
    of marks, see forget). The folders must be mounted on the driver, that of the files on the executors too."""

    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return "path string, start long, fresh boolean, again boolean, mtime double, content binary"

    def streamReader(self, schema):
        return GrowingReader(self.options)


def prefix_cut(lines: DataFrame, cut: str = "cut", key: str = "file_id") -> DataFrame:
    """lines without those before the first one later than the file's `cut` (null: keep all). Later lines that are older
    again stay: only a beginning is dropped."""
    later = F.when(F.col(cut).isNull() | (F.col("ts") > F.col(cut)), F.lit(True))
    return fill_forward(lines, later, "__open", key).where("__open or cut is null".replace("cut", f"`{cut}`")).drop("__open")


def day_segments(lines: DataFrame, start_day: str | None = None, key: str = "file_id") -> DataFrame:
    """lines with log_date: that of the last header; before the first one, start_day if given, else the first header's day.
    Lines of a file without any header keep a null log_date and so stay visible."""
    dated = fill_forward(lines, F.to_date("ts"), "log_date", key)
    first = lines.groupBy(key).agg(F.min_by(F.to_date("ts"), F.when(F.col("ts").isNotNull(), F.col("line_no"))).alias("__first"))
    seed = F.coalesce(F.col(start_day), F.col("__first")) if start_day else F.col("__first")
    return dated.join(first, key, "left").withColumn("log_date", F.coalesce("log_date", seed)).drop("__first")


def segment_batch(batch: DataFrame, state: DataFrame, formats=()) -> DataFrame:
    """path, line_no, line, ts, log_date of a micro-batch. state: path, last_ts, last_day of what is stored already."""
    known = batch.join(state.select("path", "last_ts", "last_day"), "path", "left")
    text = known.withColumn("value", F.col("content").cast("string"))
    lines = split_lines(text, key="path").withColumn("ts", parse(F.col("line"), formats))
    stored = ~F.col("again")
    seeds = known.select("path", F.when(F.col("fresh") & stored, F.col("last_ts")).alias("cut"), F.when(~F.col("fresh"), F.col("last_day")).alias("seed"))
    kept = prefix_cut(lines.join(seeds, "path"), "cut", "path")
    return day_segments(kept, "seed", "path").drop("cut", "seed")


def advanced(state: DataFrame, segments: DataFrame, again: DataFrame, number: int) -> DataFrame:
    """The state after a batch; last_ts never moves back, but for a file that is read again, which begins with this batch."""
    seen = segments.groupBy("path").agg(F.max_by("ts", F.when(F.col("ts").isNotNull(), F.col("line_no"))).alias("n_ts"), F.max("log_date").alias("n_day"))
    out = state.join(again.select("path"), "path", "left_anti").join(seen, "path", "full")
    return out.select("path", F.greatest("last_ts", "n_ts").alias("last_ts"), F.greatest("last_day", "n_day").alias("last_day"), F.coalesce("since", F.lit(number).cast("long")).alias("since"))


STATE = "path string, last_ts timestamp_ntz, last_day date, since long"


def segment_key(path, day):
    """path#day; lines of a file without any timestamp have no day."""
    return F.concat(path, F.lit("#"), F.coalesce(day.cast("string"), F.lit("")))


def segment_rows(segments: DataFrame, times: DataFrame, service_id: str) -> DataFrame:
    """Manifest rows of a batch's segments: key path#day, bytes, first and last header. times: path, mtime."""
    head = F.when(F.col("ts").isNotNull(), F.col("line_no"))
    rows = segments.groupBy("path", "log_date").agg(F.sum(F.octet_length("line") + 1).cast("long").alias("size"), F.min_by("ts", head).alias("first_ts"), F.max_by("ts", head).alias("last_ts")).join(times, "path")
    return rows.select(
        segment_key(F.col("path"), F.col("log_date")).alias("key"), F.lit(service_id).alias("service_id"), F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "log_date", F.lit(None).cast("string").alias("instance"),
        "size", F.timestamp_micros((F.col("mtime") * 1_000_000).cast("long")).alias("mtime"), "first_ts", "last_ts",
    )


def _path_of(key):
    return F.regexp_extract(key, r"(?s)^(.*)#[^#]*$", 1)


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def state_before(spark, target: str, number: int) -> DataFrame:
    """The state after the batch before; for the first one, what migrate left. Batches follow one another, so the one before
    has it; a gap is an error, as going on from no state would store lines twice."""
    if _exists(spark, f"{target}/state/{number - 1}/_SUCCESS"):
        return spark.read.schema(STATE).parquet(f"{target}/state/{number - 1}")
    if number > 0:
        raise RuntimeError(f"{target}/state/{number - 1} is missing; restore it, or start over with a new target and checkpoint")
    return spark.createDataFrame([], STATE)


def store_batch(spark, batch: DataFrame, number: int, target: str, formats=(), service_id: str = "") -> None:
    """A batch's segments, the state after it and the manifest with it, each in a place of its number: running it again
    replaces them by the same. Batches save even versions of the manifest, from 2 on; odd ones are deletions between them."""
    batch = batch.persist()
    try:
        state = state_before(spark, target, number)
        segments = segment_batch(batch, state, formats)
        segments.write.mode("overwrite").partitionBy("log_date").option("compression", "zstd").parquet(f"{target}/segments/batch={number}")
        written = spark.read.schema(segments.schema).parquet(f"{target}/segments/batch={number}")
        again = batch.where("again").select("path")
        advanced(state, written, again, number).write.mode("overwrite").parquet(f"{target}/state/{number}")
        version = 2 * (number + 1)
        manifest, _ = load_manifest(spark, f"{target}/manifest", below=version)
        kept = manifest.withColumn("path", _path_of("key")).join(again, "path", "left_anti").drop("path")
        rows = segment_rows(written, batch.select("path", "mtime"), service_id)
        save_manifest(merge_manifest(kept, rows.select(*kept.columns), append=True), f"{target}/manifest", version)
    finally:
        batch.unpersist()


def follow(spark, path: str, target: str, checkpoint: str, formats=(), service_id: str = "", **trigger):
    """Start a stream from growing files into `target`/segments (by batch and log_date), with `target`/state and
    `target`/manifest after each batch."""
    spark.dataSource.register(GrowingFiles)
    stream = spark.readStream.format("growing_files").option("path", path).option("forgotten", f"{target}/forgotten").load()
    store = lambda batch, number: store_batch(spark, batch, number, target, formats, service_id)
    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stored_segments(spark, target: str) -> DataFrame:
    """path, log_date, batch, line_no, line, ts of the segments that the manifest has, in their files' present life."""
    manifest, version = load_manifest(spark, f"{target}/manifest")
    number = version // 2 - 1
    state = spark.read.schema(STATE).parquet(f"{target}/state/{number}").select("path", "since")
    rows = spark.read.schema("path string, line_no long, line string, ts timestamp_ntz, batch long, log_date date").parquet(f"{target}/segments")
    lives = rows.where(F.col("batch") <= number).join(state, "path").where(F.col("batch") >= F.col("since"))
    return lives.join(manifest.select("key"), segment_key(F.col("path"), F.col("log_date")) == F.col("key"), "left_semi").drop("since")


def forget(spark, target: str, keys: Sequence[str]) -> None:
    """Delete segments by their keys (path#day). A file that has none left is forgotten: a mark tells the stream to read it from
    its start as if it were new. To be called between batches, with target mounted on the driver."""
    manifest, version = load_manifest(spark, f"{target}/manifest")
    gone = spark.createDataFrame([(k,) for k in keys], "key string")
    kept = manifest.join(gone, "key", "left_anti")
    paths = lambda df: df.select(_path_of("key").alias("path")).distinct()
    over = [r.path for r in paths(manifest.join(gone, "key", "left_semi")).join(paths(kept), "path", "left_anti").collect()]
    later = version if version % 2 else version + 1
    if later == version:  # a folder cannot be read and replaced at once
        held = shared_path(spark, "manifest")
        kept.write.parquet(held)
        kept = spark.read.schema(MANIFEST).parquet(held)
    save_manifest(kept, f"{target}/manifest", later)
    if over:
        os.makedirs(f"{target}/forgotten", exist_ok=True)
        name = f"{target}/forgotten/{uuid.uuid4().hex}"
        with open(f"{name}.tmp", "w", encoding="utf-8") as f:
            json.dump(over, f)
        os.replace(f"{name}.tmp", f"{name}.json")


def migrate(spark, files: DataFrame, target: str, formats=(), service_id: str = "") -> None:
    """Once, before a stream's first batch: files that were stored whole become segments. files: path, value (their text),
    mtime in seconds. The stream then reads each file from its start and stores only what is later than what it had."""
    if _exists(spark, f"{target}/state/0/_SUCCESS"):
        raise RuntimeError("the stream has begun; what it follows cannot be migrated any more")
    whole = files.select("path", F.lit(0).cast("long").alias("start"), F.lit(True).alias("fresh"), F.lit(True).alias("again"), F.col("mtime").cast("double").alias("mtime"), F.col("value").cast("binary").alias("content"))
    store_batch(spark, whole, -1, target, formats, service_id)
