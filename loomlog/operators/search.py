"""Search: entries in which a line matches, across services and files, as text-free hits."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.values import guid, number
from ..functions.regexes import Pattern
from .matching import Matcher

DEFAULT_CAP, LEAST_CAP = 2_000_000, 100_000
#: No log clock is further from UTC; a store's folders are chosen by day before services' clocks are known.
FARTHEST_CLOCK = dt.timedelta(hours=24)
FILE_DEFAULTS = {"service_id": "string", "file": "string", "log_date": "date", "instance": "string", "log_offset_minutes": "int", "file_ord": "long"}


@dataclass(frozen=True)
class Field:
    """A value that a pack takes from matched lines: `pattern`'s group v, else its first group."""

    key: str  # <pack>.<field>
    label: str
    kind: str  # string, number or guid
    pattern: Pattern
    gate: str | None = None

    @property
    def pack(self) -> str:
        return self.key.partition(".")[0]

    def column(self, line: Column) -> Column:
        group = self.pattern.number("v") or 1
        text = F.nullif(F.regexp_extract(line, self.pattern.java, group), F.lit(""))
        if self.gate:
            text = F.when(line.contains(self.gate), text)
        return {"number": number, "guid": guid}.get(self.kind, lambda t: t)(text)


@dataclass(frozen=True)
class Request:
    query: str = ""
    is_regex: bool = False
    case_sensitive: bool = False
    tree: object = None
    service_ids: tuple[str, ...] | None = None
    date_from: dt.date | None = None
    date_to: dt.date | None = None
    time_from: dt.datetime | None = None  # UTC
    time_to: dt.datetime | None = None

    @property
    def windowed(self) -> bool:
        return self.time_from is not None or self.time_to is not None

    def matcher(self, spark=None) -> Matcher:
        return Matcher(self.query, self.is_regex, self.case_sensitive, self.tree, spark)


def cap_of(configured: int) -> int | None:
    """The number of hits to keep: 0 is no limit, other values are at least LEAST_CAP."""
    return None if configured == 0 else max(configured, LEAST_CAP)


def files_of(files: DataFrame) -> DataFrame:
    """files with every column that search reads; absent ones are null, and file_ord follows file_id."""
    for name, kind in FILE_DEFAULTS.items():
        if name not in files.columns:
            ordinal = F.col("file_id") if dict(files.dtypes)["file_id"] != "string" else F.xxhash64("file_id")
            files = files.withColumn(name, (ordinal if name == "file_ord" else F.lit(None)).cast(kind))
    return files


def in_window(ts: Column, offset: Column, request: Request) -> Column:
    """ts is a log clock; the window is UTC, inclusive and open where an end is missing. Unknown clocks compare as they are."""
    utc = ts - F.make_dt_interval(F.lit(0), F.lit(0), F.coalesce(offset, F.lit(0)), F.lit(0))
    out = ts.isNotNull()
    if request.time_from is not None:
        out = out & (utc >= F.lit(request.time_from.isoformat(sep=" ")).cast("timestamp_ntz"))
    if request.time_to is not None:
        out = out & (utc <= F.lit(request.time_to.isoformat(sep=" ")).cast("timestamp_ntz"))
    return out


def in_dates(day: Column, request: Request) -> Column:
    out = F.lit(True)
    if request.date_from is not None:
        out = out & (day >= F.lit(request.date_from))
    if request.date_to is not None:
        out = out & (day <= F.lit(request.date_to))
    return out


def pruned_files(files: DataFrame, request: Request) -> DataFrame:
    """Files that a search opens: dated ones within range (a time window's ends are moved to the log clock first), and all
    undated ones."""
    files = files_of(files)
    if request.service_ids is not None:
        files = files.where(F.col("service_id").isin(*request.service_ids))
    shift = F.make_dt_interval(F.lit(0), F.lit(0), F.coalesce("log_offset_minutes", F.lit(0)), F.lit(0))
    keep = F.lit(True)
    for time, day, after in ((request.time_from, request.date_from, True), (request.time_to, request.date_to, False)):
        bound = F.to_date(F.lit(time.isoformat(sep=" ")).cast("timestamp_ntz") + shift) if time is not None else F.lit(day) if day is not None else None
        if bound is not None:
            keep = keep & ((F.col("log_date") >= bound) if after else (F.col("log_date") <= bound))
    return files.where(F.col("log_date").isNull() | keep)


def scanned(entries: DataFrame, request: Request) -> DataFrame:
    """entries without what the request's services and days rule out, by the columns that a store has as folders (see
    catalog.ingest), so that other folders are not read. Which files of a folder count is decided by pruned_files."""
    if request.service_ids is not None and "service_id" in entries.columns:
        entries = entries.where(F.col("service_id").isin(*request.service_ids))
    if "log_date" not in entries.columns:
        return entries
    first = (request.time_from - FARTHEST_CLOCK).date() if request.time_from is not None else request.date_from
    last = (request.time_to + FARTHEST_CLOCK).date() if request.time_to is not None else request.date_to
    for bound, keep in ((first, F.col("log_date") >= F.lit(first)), (last, F.col("log_date") <= F.lit(last))):
        entries = entries.where(F.col("log_date").isNull() | keep) if bound is not None else entries
    return entries


def file_spans(entries: DataFrame) -> DataFrame:
    """file_id, first_ts, last_ts: a file's first and last header."""
    head = F.when(F.col("ts").isNotNull(), F.col("line_no"))
    return entries.groupBy("file_id").agg(F.min_by("ts", head).alias("first_ts"), F.max_by("ts", head).alias("last_ts"))


def head_times(files: DataFrame, spans: DataFrame) -> DataFrame:
    """file_id, head_ts: when the lines before a file's first header were written.

    The latest last header, not after the own first one, of another file of the same service and instance; without one,
    a millisecond before the own first header. A file without headers takes the last header of the newest earlier day.
    """
    f = files_of(files).select("file_id", "service_id", "instance", "log_date").join(spans, "file_id", "left")
    source = ["service_id", "instance"]
    # Last and first headers of a source's files in one order; each file looks back at the last header before it. If that
    # is its own, the one before counts.
    ends = f.where("last_ts is not null").select(*source, "file_id", F.col("last_ts").alias("at"), F.lit(0).alias("asks"))
    earlier = F.lag("at").over(Window.partitionBy(*source).orderBy("at", "file_id"))
    ends = ends.withColumn("last", F.struct(F.col("at").alias("ts"), F.col("file_id").alias("file"), earlier.alias("earlier")))
    asks = f.where("first_ts is not null").select(*source, "file_id", F.col("first_ts").alias("at"), F.lit(1).alias("asks"))
    back = Window.partitionBy(*source).orderBy("at", "asks", "file_id").rowsBetween(Window.unboundedPreceding, 0)
    both = ends.unionByName(asks, allowMissingColumns=True).withColumn("last", F.last("last", True).over(back))
    before = F.when(F.col("last.file") == F.col("file_id"), F.col("last.earlier")).otherwise(F.col("last.ts"))
    fallback = F.col("at") - F.expr("INTERVAL '0.001' SECOND")
    headed = both.where("asks = 1").select("file_id", F.coalesce(before, fallback).alias("head_ts"))
    # Without headers: the newest earlier day's last header.
    day = F.unix_date("log_date")
    days = Window.partitionBy(*source).orderBy(day).rangeBetween(Window.unboundedPreceding, -1)
    newest = F.max(F.when(F.col("log_date").isNotNull(), F.struct("log_date", "last_ts"))).over(days)["last_ts"]
    bare = f.withColumn("head_ts", F.when(F.col("log_date").isNotNull(), newest)).where("first_ts is null").select("file_id", "head_ts")
    return headed.unionByName(bare)


def hits_of(
    entries: DataFrame, files: DataFrame, request: Request, fields: Sequence[Field] = (), matcher: Matcher | None = None, part: Column | None = None, seen: Observation | None = None
) -> DataFrame:
    """file_id, line_no, entry_line, ts, matched_groups, one column per field key, service_id, file, file_ord: one row per hit.

    entries: file_id, line_no, line, ts, entry_line, entry_ts, and service_id and log_date where a store has them as folders:
    then only the folders of the files that are searched are read. files: file_id, and what else of FILE_DEFAULTS is known;
    with first_ts and last_ts too (a manifest has them), head blocks are dated without reading entries again. With pack_id, a
    field is taken from lines of its own pack only, so lines of a service whose pack is not loaded are searched but have
    no fields; without it every field is looked for everywhere. A hit is an entry with a matching line and no excluding one,
    at its header; a head block is one hit at its first matching line. Fields come from matching lines only; the earliest
    line that has a field wins. Only lines that match or exclude are grouped, so the shuffle holds no other text.

    part: a condition on files; others are not searched, but head blocks are dated by them too. seen counts the lines.
    """
    matcher = matcher or request.matcher()
    known = pruned_files(files, request)
    chosen = known if part is None else known.where(part)
    line = F.col("line")
    packed = "pack_id" in files.columns
    extra = [F.col("pack_id").alias("__pack")] if packed else []
    asked = chosen.select(F.col("file_id").alias("__file"), F.col("service_id").alias("__service"), F.col("log_date").alias("__day"), F.col("log_offset_minutes").alias("__offset"), *extra)
    # Equal folders too, not only equal files: that is what lets the scan read the chosen files' folders only.
    same = [F.col("file_id") == F.col("__file")]
    same += [F.col("service_id") == F.col("__service")] if {"service_id"} <= {*entries.columns} & {*files.columns} else []
    day = lambda c: F.coalesce(c, F.to_date(F.lit("0001-01-01")))  # noqa: E731  Spark prunes by equality, not by its null-safe kind
    same += [day("log_date") == day("__day")] if {"log_date"} <= {*entries.columns} & {*files.columns} else []
    rows = scanned(entries, request).join(asked, reduce(Column.__and__, same))
    if seen is not None:
        rows = rows.observe(seen, F.count(F.lit(1)).alias("lines"))
    taken = lambda f: F.when(F.col("__hit") & (F.col("__pack") == f.pack if packed else F.lit(True)), f.column(line))
    headed = F.col("entry_ts").isNotNull()
    if request.windowed:
        rows = rows.where(~headed | in_window(F.col("entry_ts"), F.col("__offset"), request))
    else:
        rows = rows.where(~headed | F.col("__day").isNotNull() | in_dates(F.to_date("entry_ts"), request))
    excluded = matcher.excludes(line)
    rows = rows.withColumn("__out", excluded).withColumn("__hit", ~F.col("__out") & matcher.is_match(line)).where("__out or __hit")
    rows = rows.select("file_id", "line_no", "entry_line", "entry_ts", "__out", "__hit", F.when(F.col("__hit"), matcher.group_mask(line)).alias("__mask"), *[taken(f).alias(f.key) for f in fields])
    at = F.when(F.col("__hit"), F.col("line_no"))
    picked = [F.min_by(F.col(f"`{f.key}`"), F.when(F.col(f"`{f.key}`").isNotNull(), F.col("line_no"))).alias(f.key) for f in fields]
    grouped = rows.groupBy("file_id", "entry_line").agg(
        F.bool_or("__out").alias("__out"), F.min(at).alias("__first"), F.max("entry_ts").alias("ts"), F.coalesce(F.bit_or("__mask"), F.lit(0).cast("long")).alias("matched_groups"), *picked
    )
    grouped = grouped.where("not __out and __first is not null")
    spans = known.select("file_id", "first_ts", "last_ts") if {"first_ts", "last_ts"} <= set(known.columns) else file_spans(scanned(entries, request))
    info = chosen.select("file_id", "service_id", "file", "file_ord", "log_date", "log_offset_minutes").join(head_times(known, spans), "file_id", "left")
    found = grouped.join(info, "file_id")
    head = F.col("entry_line").isNull()
    found = found.select("file_id", F.coalesce("entry_line", "__first").alias("line_no"), "entry_line", F.when(head, F.col("head_ts")).otherwise(F.col("ts")).alias("ts"), "matched_groups", *[F.col(f"`{f.key}`") for f in fields], "service_id", "file", "file_ord", "log_date", "log_offset_minutes")
    if request.windowed:
        within = in_window(F.col("ts"), F.col("log_offset_minutes"), request)
    else:
        within = F.col("log_date").isNotNull() | (F.col("ts").isNotNull() & in_dates(F.to_date("ts"), request)) | F.lit(request.date_from is None and request.date_to is None)
    return found.where(~head | within).drop("log_date", "log_offset_minutes")


def default_order() -> list[tuple[str, bool]]:
    """Newest first, undated before all, ties in reverse scan order: (column, ascending) pairs. Nulls are last where
    ascending and first where descending, so that turning every direction round reverses the order exactly."""
    return [("ts", False), ("file_ord", False), ("line_no", False)]


def order_columns(order: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.col(f"`{c}`").asc_nulls_last() if up else F.col(f"`{c}`").desc_nulls_first() for c, up in order]


def nth_least(rows: DataFrame, column: str, n: int, some: int = 10_000) -> tuple[int, int]:
    """The n-th least value (from 1) of a column of integers without nulls, and how many rows have a lesser one; rows has n
    at least. Rows are counted between 63 quantiles, and looked into where the n-th lies, until there are few; the driver
    gets 64 counts at a time, and no task more than its own rows."""
    below, c = 0, F.col(column)
    while True:
        marks = sorted(set(rows.agg(F.percentile_approx(c, [k / 64 for k in range(1, 64)], 1000)).first()[0]))
        at = reduce(lambda x, k: F.when(c <= marks[k], k).otherwise(x), reversed(range(len(marks))), F.lit(len(marks)))
        counts = dict(rows.groupBy(at.alias("at")).agg(F.struct(F.count(F.lit(1)).alias("n"), F.min(c).alias("low"), F.max(c).alias("high"))).collect())
        for k in sorted(counts):
            if below + counts[k].n >= n:
                break
            below += counts[k].n
        inside = counts[k]
        if inside.low == inside.high:
            return inside.low, below
        rows = rows.where(c.between(inside.low, inside.high))
        if inside.n <= some:
            values = sorted(r[0] for r in rows.select(c).collect())
            value = values[n - below - 1]
            return value, below + values.index(value)


def capped(hits: DataFrame, cap: int | None) -> DataFrame:
    """The first `cap` (1 or more) hits in scan order (file order, then line): those up to the cap-th one, which is found by
    counting. Files of one ordinal count as one. Runs jobs on hits, so they should be written ones."""
    if cap is None or hits.count() <= cap:
        return hits
    found, n, left = {}, cap, hits
    for key in ("file_ord", "line_no"):
        found[key], below = nth_least(left, key, n)
        left, n = left.where(F.col(key) == found[key]), n - below
    order, line = F.col("file_ord"), F.col("line_no")
    return hits.where((order < found["file_ord"]) | ((order == found["file_ord"]) & (line <= found["line_no"])))
