"""Which files there are, which of them are stored, and what the stored ones cover."""

from __future__ import annotations

import datetime as dt
import posixpath
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.packs import Location

MOST_OFFSET_MINUTES = 14 * 60
MANIFEST = "key string, service_id string, file string, log_date date, instance string, size long, mtime timestamp, first_ts timestamp_ntz, last_ts timestamp_ntz"


def resolve_root(root: str | None, endpoint: str) -> str:
    """A relative endpoint lies under root, an absolute one stands alone; no part may lead upwards."""
    if ".." in endpoint.replace("\\", "/").split("/"):
        raise ValueError("A folder may not contain ..")
    return endpoint if endpoint.startswith("/") or not root else posixpath.join(root, endpoint)


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """name, path, size, mtime of a folder's files; their content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(folder).select("path", "length", "modificationTime")
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def _date(name: Column, location: Location) -> Column:
    part = lambda g: F.regexp_extract(name, location.file.java, location.file.number(g)).cast("int")
    return F.to_date(F.try_make_timestamp_ntz(part("y"), part("m"), part("d"), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)")))


def files_for_range(files: DataFrame, location: Location, date_from: dt.date | None = None, date_to: dt.date | None = None) -> DataFrame:
    """files whose name fits the location, with log_date and instance; dated ones within the range only. A name with an
    impossible date is left out."""
    name = F.col("name")
    out = files.where(name.rlike(location.file.java))
    instance = F.nullif(F.regexp_extract(name, location.file.java, location.file.number("instance")), F.lit("")) if location.file.number("instance") else F.lit(None).cast("string")
    out = out.withColumn("log_date", _date(name, location) if location.dated else F.lit(None).cast("date")).withColumn("instance", instance)
    if location.dated:
        out = out.where("log_date is not null")
        if date_from is not None:
            out = out.where(F.col("log_date") >= F.lit(date_from))
        if date_to is not None:
            out = out.where(F.col("log_date") <= F.lit(date_to))
    return out.orderBy("name")


def detect_location(files: DataFrame, locations: Sequence[Location]) -> str | None:
    """The first location, as declared, that some file's directory and name fit. files: dir, name."""
    rank = F.lit(None).cast("int")
    for k in reversed(range(len(locations))):
        x = locations[k]
        fits = (F.lower(F.trim(F.col("dir"), F.lit("/"))) == x.dir.strip("/").lower()) & F.col("name").rlike(x.file.java)
        rank = F.when(fits, F.lit(k)).otherwise(rank)
    first = files.agg(F.min(rank)).first()[0]
    return None if first is None else locations[first].id


def sync_decisions(files: DataFrame, manifest: DataFrame, today: dt.date) -> DataFrame:
    """files with `decision`: new, changed (fetch again), append (a live one that has grown) or current. files and manifest
    share key, size and mtime. A file is live if it is undated or of today."""
    have = manifest.select("key", F.col("size").alias("__size"), F.col("mtime").alias("__mtime"))
    same = (F.col("size") == F.col("__size")) & (F.col("mtime") == F.col("__mtime"))
    live = F.col("log_date").isNull() | (F.col("log_date") == F.lit(today))
    decision = F.when(F.col("__size").isNull(), "new").when(live & (F.col("size") >= F.col("__size")), F.when(same, "probe").otherwise("append")).when(same, "current").otherwise("changed")
    return files.join(have, "key", "left").withColumn("decision", decision).drop("__size", "__mtime")


def upsert_services(configured: DataFrame, found: DataFrame) -> DataFrame:
    """service_id, name, environment, endpoint, location: endpoints set by hand stay, nothing becomes null, missing
    locations are filled in, new services are added."""
    f = found.select("service_id", *[F.col(c).alias(f"f_{c}") for c in ("name", "environment", "endpoint", "location")])
    merged = configured.join(f, "service_id", "full")
    pick = lambda c: F.coalesce(c, f"f_{c}").alias(c)
    endpoint = F.when(F.coalesce("manual", F.lit(False)), F.col("endpoint")).otherwise(F.coalesce("f_endpoint", "endpoint")).alias("endpoint")
    return merged.select("service_id", pick("name"), pick("environment"), endpoint, pick("location"), F.coalesce("manual", F.lit(False)).alias("manual")).orderBy(F.lower("service_id"), "service_id")


def seed_services(configured: DataFrame, static: DataFrame, seeded: DataFrame) -> DataFrame:
    """Services of static lists that were never seeded before; deleted ones so stay deleted."""
    return static.join(seeded.select("service_id"), "service_id", "left_anti").join(configured.select("service_id"), "service_id", "left_anti")


def status(manifest: DataFrame) -> DataFrame:
    """Per service: files, bytes, oldest and newest moment (a dated file without timestamps counts from its midnight)."""
    midnight = F.to_timestamp_ntz(F.date_format("log_date", "yyyy-MM-dd"))
    return manifest.groupBy("service_id").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.min(F.coalesce("first_ts", midnight)).alias("oldest"), F.max(F.coalesce("last_ts", midnight)).alias("newest")
    )


def coverage_gaps(manifest: DataFrame) -> DataFrame:
    """service_id, gap_from, gap_to: whole days without anything, with the last moment before and the first after."""
    start = F.to_timestamp_ntz(F.date_format("log_date", "yyyy-MM-dd"))
    first, last = F.coalesce("first_ts", start), F.coalesce("last_ts", start + F.expr("INTERVAL '23:59:59' HOUR TO SECOND"))
    spans = manifest.select("service_id", first.alias("first"), last.alias("last")).where("first is not null and last is not null and to_date(last) >= to_date(first)")
    days = spans.withColumn("day", F.explode(F.sequence(F.to_date("first"), F.to_date("last"))))
    low = F.to_timestamp_ntz(F.date_format("day", "yyyy-MM-dd"))
    days = days.groupBy("service_id", "day").agg(F.min(F.greatest("first", low)).alias("first"), F.max(F.least("last", low + F.expr("INTERVAL '23:59:59' HOUR TO SECOND"))).alias("last"))
    w = Window.partitionBy("service_id").orderBy("day")
    stepped = days.withColumn("before", F.lag("day").over(w)).withColumn("gap_from", F.lag("last").over(w))
    return stepped.where(F.datediff("day", "before") > 1).select("service_id", "gap_from", F.col("first").alias("gap_to"))


def clock_offsets(manifest: DataFrame) -> DataFrame:
    """service_id, offset_minutes: how far a service's log clock runs ahead of UTC, as the median of last entry less last
    write, to a quarter of an hour. Of a growing file's day segments (key path#yyyy-mm-dd) only the newest counts."""
    path, day = F.regexp_extract("key", r"^(.*)#\d{4}-\d{2}-\d{2}$", 1), F.regexp_extract("key", r"#(\d{4}-\d{2}-\d{2})$", 1)
    rows = manifest.withColumn("__path", F.when(day != "", path).otherwise(F.col("key"))).withColumn("__day", day)
    rows = rows.withColumn("__newest", F.max("__day").over(Window.partitionBy("service_id", "__path"))).where("__day = __newest")
    micros = F.unix_micros(F.col("last_ts").cast("timestamp")) - F.unix_micros(F.col("mtime").cast("timestamp"))
    minutes = F.when(micros >= 0, F.floor(micros / 60_000_000)).otherwise(F.ceil(micros / 60_000_000)).cast("int")
    rows = rows.withColumn("__minutes", minutes).where(F.abs("__minutes") <= MOST_OFFSET_MINUTES)
    # The upper median of n values is the smallest with at least floor(n / 2) + 1 at or below it.
    counts = rows.groupBy("service_id", "__minutes").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("service_id").orderBy("__minutes")
    counts = counts.withColumn("__upto", F.sum("n").over(w)).withColumn("__all", F.sum("n").over(Window.partitionBy("service_id")))
    median = counts.where(F.col("__upto") >= F.floor(F.col("__all") / 2) + 1).groupBy("service_id").agg(F.min("__minutes").alias("m"))
    quarter = F.signum(F.col("m") / 15) * F.floor(F.abs(F.col("m") / 15) + 0.5)
    return median.select("service_id", (quarter * 15).cast("int").alias("offset_minutes"))


def common_offset(offsets: DataFrame) -> int | None:
    """The offset all services share, else None. One row comes back, whatever the number of services."""
    row = offsets.agg(F.count(F.lit(1)).alias("n"), F.count("offset_minutes").alias("known"), F.min("offset_minutes").alias("low"), F.max("offset_minutes").alias("high")).first()
    return row["low"] if row["n"] and row["n"] == row["known"] and row["low"] == row["high"] else None


def instances(manifest: DataFrame) -> DataFrame:
    """Services whose files come from several instances."""
    return manifest.groupBy("service_id").agg(F.countDistinct("instance").alias("n_instances")).where("n_instances > 1")


def stored_files(manifest: DataFrame) -> DataFrame:
    return manifest.orderBy(F.col("log_date").desc_nulls_last(), "file")


def forget(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    return manifest.join(keys.select("key"), "key", "left_anti")


def time_spans(entries: DataFrame, key: str = "file_id") -> DataFrame:
    """First and last header of each file."""
    head = F.when(F.col("ts").isNotNull(), F.col("line_no"))
    return entries.groupBy(key).agg(F.min_by("ts", head).alias("first_ts"), F.max_by("ts", head).alias("last_ts"))


def ingest(entries: DataFrame, path: str, by: Sequence[str] = ("service_id", "log_date")) -> None:
    """Store dated, anchored lines once; searches then scan, filter and group them. Columns of `by` become folders, by which
    searches prune; entries has them (log_date null: undated)."""
    entries.write.mode("append").option("compression", "zstd").partitionBy(*by).parquet(path)


def stored_entries(spark: SparkSession, path: str, by: Sequence[str] = ("service_id", "log_date")) -> DataFrame:
    """What ingest has stored. Folder names are read as what they were: a service called 007 stays a text."""
    kinds = {"service_id": "string", "log_date": "date"}
    found = spark.read.parquet(path).schema
    names = ", ".join(f"`{f.name}` {kinds.get(f.name, 'string') if f.name in by else f.dataType.simpleString()}" for f in found)
    return spark.read.schema(names).parquet(path)


def visible_files(manifest: DataFrame, services: DataFrame, needle: str = "", environment: str | None = None, service_ids: Sequence[str] | None = None) -> DataFrame:
    """manifest with service_name, for services of the environment (and of the selection) whose name, or the file's, holds
    needle in any case. services: service_id, name, environment."""
    chosen = services.select("service_id", F.col("name").alias("service_name"), "environment")
    if environment is not None:
        chosen = chosen.where(F.col("environment") == environment)
    if service_ids is not None:
        chosen = chosen.where(F.col("service_id").isin(*service_ids))
    shown = manifest.join(chosen.drop("environment"), "service_id")
    fits = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(needle.lower()))
    return shown.where(fits(F.col("file")) | fits(F.col("service_name"))) if needle else shown


def total_bytes(files: DataFrame) -> DataFrame:
    return files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
