"""Text files as numbered lines, and lines as entries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.regexes import Pattern
from ..functions.timestamps import parse, parse_by
from ..sources.ranges import listed, zstd_lines

#: Lines of a file that one task fills forward; a larger file is dealt over several tasks.
CHUNK_LINES = 1_000_000
#: Files whose splits' counts are sent to all tasks, some 100 bytes for each.
MOST_SENT = 200_000
#: An entry's text stops growing here, as bytes of continuation lines.
ENTRY_MAX_BYTES = 64 * 1024


def read_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """file, line_no (from 1), line of text files, plain or compressed. zstd files are read by runs of frames (see
    sources.ranges); a file of another compression is one task, which reads it line by line.

    A large plain file is read in splits by many tasks. Lines of a split are consecutive rows of its task, so a line's
    number is that of its row, less the split's first, plus the lines of the file's earlier splits. Those two numbers, one
    row per split, come from counting rows without their text; no line is shuffled for them, unless there are more files
    than MOST_SENT: then lines meet them by file."""
    known = listed(spark, paths)
    framed = [f for f in known if f.endswith((".zst", ".zstd"))]
    plain = [f for f in known if not f.endswith((".zst", ".zstd"))]
    if not framed:
        return _plain_lines(spark, list(paths), len(plain))
    lines = zstd_lines(spark, framed)
    return lines.unionByName(_plain_lines(spark, [unquote(f) if f.startswith("file:") else f for f in plain], len(plain))) if plain else lines


def _plain_lines(spark: SparkSession, paths: list[str], n: int) -> DataFrame:
    rows = spark.read.option("lineSep", "\n").text(paths)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__split"), F.monotonically_increasing_id().alias("__row"), "value")
    splits = rows.groupBy("file", "__split").agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "__split", (before - F.col("__first") + 1).alias("__shift"))
    line = F.rtrim(F.make_valid_utf8("value"), F.lit("\r"))
    # One row for each file and, of larger ones, for each spark.sql.files.maxPartitionBytes.
    splits = F.broadcast(splits) if n <= MOST_SENT else splits.hint("merge")
    return rows.join(splits, ["file", "__split"]).select("file", (F.col("__row") + F.col("__shift")).alias("line_no"), line.alias("line"))


def split_lines(files: DataFrame, text: str = "value", key: str = "file_id") -> DataFrame:
    """key, line_no (from 1), line. Lines end at \\n; trailing \\r are dropped; a final \\n opens no further line; bytes
    that are not UTF-8 become U+FFFD. Null and empty texts have no lines."""
    parts = F.split(F.make_valid_utf8(F.col(text)), "\n")
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    rows = files.select(key, F.posexplode(parts).alias("pos", "line"))
    return rows.select(key, (F.col("pos") + 1).cast("long").alias("line_no"), F.rtrim("line", F.lit("\r")).alias("line"))


def fill_forward(rows: DataFrame, value: Column, name: str, key: str = "file_id", order: str = "line_no", chunk: int = CHUNK_LINES) -> DataFrame:
    """rows with the last non-null value so far in each key's order.

    Filled within chunks first; then each chunk's last value, one row per chunk, is carried on to the chunks after it, so
    a file of any length is shared by many tasks."""
    held = rows.withColumn("__value", value).withColumn("__chunk", F.floor(F.col(order) / chunk))
    within = Window.partitionBy(key, "__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = held.groupBy(key, "__chunk").agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.col(order))).alias("__last"))
    before = Window.partitionBy(key).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(key, "__chunk", F.last("__last", True).over(before).alias("__carried")).where("__carried is not null")
    filled = held.withColumn("__filled", F.last("__value", True).over(within))
    out = filled.join(carried, [key, "__chunk"], "left").withColumn(name, F.coalesce("__filled", "__carried"))
    return out.drop("__value", "__chunk", "__filled", "__carried")


def to_entries(lines: DataFrame, formats: Sequence[str | Pattern] | Mapping[str, Sequence] = (), key: str = "file_id", chunk: int = CHUNK_LINES, tag: str = "pack_id") -> DataFrame:
    """lines with ts (of header lines), entry_line and entry_ts: the header each line belongs to; both are null in a
    file's head block. This is what ingestion stores, as it depends on the timestamp formats only. A mapping gives the
    formats of each pack, whose id lines have in the column `tag`."""
    stamp = parse_by(F.col(tag), F.col("line"), formats) if isinstance(formats, Mapping) else parse(F.col("line"), formats)
    stamped = lines.withColumn("ts", stamp)
    head = F.when(F.col("ts").isNotNull(), F.struct(F.col("line_no").alias("entry_line"), F.col("ts").alias("entry_ts")))
    return fill_forward(stamped, head, "__head", key, "line_no", chunk).select("*", "__head.entry_line", "__head.entry_ts").drop("__head")


def entry_text(entries: DataFrame, key: str = "file_id", limit: int = ENTRY_MAX_BYTES) -> DataFrame:
    """key, entry_line (null: head block), first_line, text: lines joined by newlines. Continuation lines are added while
    the text has fewer than `limit` bytes; the first line is never cut."""
    # A line has a byte at least, so no line further than `limit` from its entry's first can be in: an entry without end
    # (a file without headers is one) is cut before its lines meet in a task.
    heads = entries.where("entry_line is null")
    first = heads.groupBy(key).agg(F.min("line_no").alias("__first"))
    near = entries.where(F.col("line_no") - F.col("entry_line") <= limit)
    near = near.unionByName(heads.join(first, key).where(F.col("line_no") - F.col("__first") <= limit).drop("__first"))
    size = F.octet_length("line") + 1
    before = Window.partitionBy(key, "entry_line").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    kept = near.withColumn("__before", F.coalesce(F.sum(size).over(before), F.lit(0))).where(F.col("__before") <= limit)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return kept.groupBy(key, "entry_line").agg(F.min("line_no").alias("first_line"), joined.alias("text"))


def around(lines: DataFrame, before: int, after: int, key: str = "file_id", bucket: int = CHUNK_LINES) -> DataFrame:
    """lines with context_before and context_after: the physical lines around each, bounded by the file. A file is cut in
    buckets of lines; those near a bucket's edge are in the neighbouring one too, so no task gets a whole file."""
    at = F.col("line_no")
    bucket = max(bucket, before + after + 1)
    reach = F.explode(F.sequence(F.floor((at - after) / bucket), F.floor((at + before) / bucket))).alias("__bucket")
    w = Window.partitionBy(key, "__bucket").orderBy("line_no")
    found = lines.select("*", reach).select(
        "*",
        (F.collect_list("line").over(w.rowsBetween(-before, -1)) if before else F.array().cast("array<string>")).alias("context_before"),
        (F.collect_list("line").over(w.rowsBetween(1, after)) if after else F.array().cast("array<string>")).alias("context_after"),
    )
    return found.where(F.col("__bucket") == F.floor(at / bucket)).drop("__bucket")


def raw_window(lines: DataFrame, offset: int, limit: int) -> DataFrame:
    """`limit` lines from the offset-th on (counting from 0); fewer at the end of the file."""
    return lines.where(F.col("line_no").between(offset + 1, offset + limit)).orderBy("line_no")


def raw_search(lines: DataFrame, line_matches: Column | None, limit: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """(total, first hits with their text cut to 500 characters); without a condition nothing is found."""
    found = lines.where(F.lit(False) if line_matches is None else line_matches)
    return found.agg(F.count(F.lit(1)).alias("total")), found.orderBy("line_no").limit(limit).withColumn("line", F.substring("line", 1, 500))
