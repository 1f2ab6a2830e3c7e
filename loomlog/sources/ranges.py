"""Parts of files, read where they are needed: byte ranges of plain files, runs of frames of zstd files.

Tasks open files through pyarrow's file systems (local and mounted folders, HDFS, S3, GCS, Azure) and read only their part,
so a file of any size is shared by many tasks and none holds it whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from urllib.parse import unquote, urlsplit

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import shared_path

RANGE = 16 << 20
RUN = 16 << 20  # compressed bytes of a run of frames
BLOCK = 1 << 16
FRAME, SKIPPABLE, SKIP_KINDS = 0xFD2FB528, 0x184D2A50, 16
LINES = 1 << 22  # bytes of lines that leave a task at once


def open_file(path: str) -> pa.NativeFile:
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(path.removeprefix("file:").removeprefix("//") if parts.scheme else path)
    system, inside = fs.FileSystem.from_uri(path)
    return system.open_input_file(inside)


def open_listed(uri: str) -> pa.NativeFile:
    """A file by its name in a list of Spark's, where special characters are escaped."""
    return open_file(unquote(uri) if uri.startswith("file:") else uri)


def after_line(file: pa.NativeFile, at: int, end: int) -> int:
    """The place behind the first line feed from `at` on, or end."""
    while at < end:
        block = file.read_at(min(BLOCK, end - at), at)
        if not block:
            break
        if (k := block.find(b"\n")) >= 0:
            return at + k + 1
        at += len(block)
    return end


def read_range(path: str, first: int, start: int, end: int, size: int) -> tuple[int, bytes]:
    """The lines that begin in [start, end) of a file of `size` bytes, whose reading begins at `first`; where they begin. A
    file that is shorter than `size` is an error."""
    with open_file(path) as file:
        if file.size() < size:
            raise EOFError(f"has {file.size()} bytes, {size} when it was listed")
        start = start if start == first else after_line(file, start - 1, size)
        end = end if end >= size else after_line(file, end - 1, size)
        return start, file.read_at(end - start, start) if end > start else b""


def fetch_ranges(wanted: DataFrame, step: int = RANGE) -> DataFrame:
    """key, start, content, error of what lies beyond `start` of each file, in parts of whole lines of about `step` bytes.
    wanted: key, path, start, size (as listed: what is written later is left for later). A file that is gone or has become
    shorter has rows with the error and no content; the others are not affected. Nothing new gives one empty part."""
    first, size = F.col("start"), F.greatest("size", "start")
    parts = wanted.select("key", "path", F.col("start").alias("first"), size.alias("size"), F.explode(F.sequence(first, F.greatest(size - 1, first), F.lit(step).cast("long"))).alias("start"))
    parts = parts.withColumn("end", F.least(F.col("start") + step, "size"))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                try:
                    start, content = read_range(r["path"], r["first"], r["start"], r["end"], r["size"])
                    if not content and r["start"] > r["first"]:
                        continue  # one long line, which began before
                    error = None
                except Exception as e:  # whatever happens to one file
                    start, content, error = r["start"], None, f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([r["key"]], pa.string()), pa.array([start], pa.int64()), pa.array([content], pa.binary()), pa.array([error], pa.string())], ["key", "start", "content", "error"])

    n = max(1, min(parts.count(), 10_000))
    return parts.repartition(n, "key", "start").mapInArrow(run, "key string, start long, content binary, error string")


def frames(file: pa.NativeFile) -> Iterator[tuple[int, int]]:
    """Start and end of each zstd frame; only headers of frames and of their blocks are read."""
    at, size = 0, file.size()
    while at < size:
        head = file.read_at(min(18, size - at), at)
        magic = int.from_bytes(head[:4], "little")
        if SKIPPABLE <= magic < SKIPPABLE + SKIP_KINDS:
            at += 8 + int.from_bytes(head[4:8], "little")
            continue
        if magic != FRAME:
            raise ValueError(f"no zstd frame at byte {at}")
        start, checksum = at, zstandard.get_frame_parameters(head).has_checksum
        at += zstandard.frame_header_size(head)
        last = False
        while not last:
            block = int.from_bytes(file.read_at(3, at), "little")
            last, kind, length = block & 1, block >> 1 & 3, block >> 3
            at += 3 + (1 if kind == 1 else length)
            if at > size:
                raise EOFError("a frame is cut off")
        at += 4 if checksum else 0
        yield start, at


def frame_runs(spark: SparkSession, paths: DataFrame, run_bytes: int = RUN) -> DataFrame:
    """file, run (from 0), start, end, size: consecutive frames of about run_bytes each. paths: file."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, begin, end = [], 0, 0
                with open_listed(path) as file:
                    size = file.size()
                    for start, end in frames(file):
                        if end - begin >= run_bytes:
                            rows.append((begin, end))
                            begin = end
                if end > begin:
                    rows.append((begin, end))
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(range(n), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([size] * n, pa.int64())], ["file", "run", "start", "end", "size"])

    n = max(1, min(paths.count(), 10_000))
    return paths.select("file").repartition(n, "file").mapInArrow(run, "file string, run long, start long, end long, size long")


class _Part:
    """File-like: the bytes of a file from start on, and how far they were read."""

    def __init__(self, file: pa.NativeFile, start: int, end: int):
        self.file, self.at, self.end = file, start, end

    def read(self, n: int = -1) -> bytes:
        n = self.end - self.at if n < 0 else min(n, self.end - self.at)
        data = self.file.read_at(n, self.at) if n else b""
        self.at += len(data)
        return data


def _decompressed(file: pa.NativeFile, start: int, end: int) -> Iterator[bytes]:
    reader = zstandard.ZstdDecompressor().stream_reader(_Part(file, start, end), read_across_frames=True)
    while data := reader.read(1 << 20):
        yield data


def run_lines(path: str, start: int, end: int, size: int) -> Iterator[list[bytes]]:
    """The lines of a run, some at a time, without line feeds: not the line that the run begins within (or at), but of the
    next run the line that is its first. So each line is of one run, without a look at the bytes before it."""
    with open_listed(path) as file:
        rest, skipping = [], start > 0
        for data in _decompressed(file, start, end):
            if skipping:
                k = data.find(b"\n")
                if k < 0:
                    continue
                data, skipping = data[k + 1 :], False
            lines = data.split(b"\n")
            if len(lines) > 1:
                lines[0] = b"".join([*rest, lines[0]])
                rest = [lines.pop()]
                yield lines
            else:
                rest.append(lines[0])
        if skipping:
            return  # within one line that began before and goes on
        found = False
        for data in _decompressed(file, end, size) if end < size else ():
            k = data.find(b"\n")
            rest.append(data if k < 0 else data[:k])
            if k >= 0:
                found = True
                break
        last = b"".join(rest)
        if last or found:
            yield [last]


def zstd_lines(spark: SparkSession, files: Sequence[str], run_bytes: int = RUN) -> DataFrame:
    """file, line_no (from 1), line of zstd files, a task for each run of frames. A file's line numbers come from counts of
    its runs' lines, one row for each run; for them files are decompressed once more, without making lines."""
    place = shared_path(spark, "frames")
    frame_runs(spark, spark.createDataFrame([(f,) for f in files], "file string"), run_bytes).write.parquet(place)
    runs = spark.read.parquet(place)
    n = max(1, min(runs.count(), 10_000))
    dealt = runs.repartition(n, "file", "run")

    def count(batches):
        for batch in batches:
            for r in batch.to_pylist():
                total = sum(map(len, run_lines(r["file"], r["start"], r["end"], r["size"])))
                yield pa.RecordBatch.from_arrays([pa.array([r["file"]], pa.string()), pa.array([r["run"]], pa.int64()), pa.array([total], pa.int64())], ["file", "run", "n"])

    counts = dealt.mapInArrow(count, "file string, run long, n long")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = runs.join(counts.select("file", "run", before.alias("before")), ["file", "run"]).repartition(n, "file", "run")

    def read(batches):
        for batch in batches:
            for r in batch.to_pylist():
                at, held, size = r["before"], [], 0
                for lines in run_lines(r["file"], r["start"], r["end"], r["size"]):
                    held += lines
                    size += sum(map(len, lines))
                    if size >= LINES or len(held) >= 100_000:
                        yield rows(r["file"], at, held)
                        at, held, size = at + len(held), [], 0
                if held:
                    yield rows(r["file"], at, held)

    def rows(path, at, lines):
        return pa.RecordBatch.from_arrays([pa.array([path] * len(lines), pa.string()), pa.array(range(at + 1, at + 1 + len(lines)), pa.int64()), pa.array(lines, pa.binary())], ["file", "line_no", "bytes"])

    found = numbered.select("file", "start", "end", "size", "before").mapInArrow(read, "file string, line_no long, bytes binary")
    # Named as Spark's readers name the file in their metadata.
    return found.select(F.regexp_replace("file", "^file:///", "file:/").alias("file"), "line_no", F.rtrim(F.make_valid_utf8(F.col("bytes").cast("string")), F.lit("\r")).alias("line"))


def listed(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The files that Spark lists for paths (files, folders, patterns)."""
    return list(spark.read.text(list(paths)).inputFiles())
