"""Bringing services' files in: list, decide, fetch, store, and keep the manifest; one failing service or file stops no other.

A stored file is one or more chunks of its bytes, rows of a Parquet table (zstd) with the place of each in the file. A file
that has grown gets a chunk more, one that was rewritten a new version; the manifest says which version counts. Files of all
services are fetched in one job, a task for a few files each.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.timestamps import parse_by
from ..operators.lines import MOST_SENT
from ..plans.packs import Pack, Registry
from . import catalog, store
from .http_vfs import AccessDenied, fetch_parts, list_folder
from .ranges import fetch_ranges

LISTED = "name string, path string, size long, mtime timestamp"
FETCHED = "key string, start long, content binary, error string"
CHUNKS = "service_id string, key string, version long, start long, content binary"
FILE_ATTEMPTS = 2


class TokenSource:
    """A bearer token from `get() -> (token, seconds that it holds)`, kept until `margin` seconds before its end."""

    def __init__(self, get: Callable[[], tuple[str, float]], margin: float = 300, clock: Callable[[], float] = time.time):
        self.get, self.margin, self.clock, self.token, self.until = get, margin, clock, None, 0.0

    def __call__(self, fresh: bool = False) -> str:
        if fresh or self.token is None or self.clock() >= self.until - self.margin:
            self.token, holds = self.get()
            self.until = self.clock() + holds
        return self.token


class LocalFolder:
    """Files that Spark's readers reach: a mounted folder, or any file system of the cluster."""

    needs_token = False

    def list(self, spark: SparkSession, pack: Pack, service: dict, folder: str, token: str | None) -> DataFrame:
        root = catalog.resolve_root(pack.manifest["source"].get("root"), service["endpoint"])
        return catalog.listing(spark, f"{root.rstrip('/')}/{folder.strip('/')}".rstrip("/"))

    def fetch(self, spark: SparkSession, wanted: DataFrame, tokens: dict[str, str]) -> DataFrame:
        """wanted: key, path, start, size. What lies beyond `start`, which is nothing where the file has not grown."""
        return fetch_ranges(wanted)


class HttpFolder:
    """Files behind an HTTP folder API; see http_vfs."""

    needs_token = True

    def list(self, spark: SparkSession, pack: Pack, service: dict, folder: str, token: str | None) -> DataFrame:
        base = f"{service['endpoint'].rstrip('/')}/api/vfs/{folder.strip('/')}".rstrip("/")
        entries = [e for e in list_folder(service["endpoint"], folder, token) if e.get("mime") != "inode/directory"]
        rows = [(e["name"], f"{base}/{e['name']}", int(e["size"]), pd.Timestamp(e["mtime"]).tz_convert("UTC").to_pydatetime() if e.get("mtime") else None) for e in entries]
        return spark.createDataFrame(rows, LISTED)

    def fetch(self, spark: SparkSession, wanted: DataFrame, tokens: dict[str, str]) -> DataFrame:
        """Rows of a bounded part of a file each. A broken connection is taken up where it broke; a file that fails has a row
        with its error, and parts that came before do not count."""

        def run(frames):
            for frame in frames:
                for row in frame.itertuples():
                    try:
                        for start, content in fetch_parts(row.path, tokens.get(row.service_id), int(row.start)):
                            yield pd.DataFrame({"key": [row.key], "start": [start], "content": [content], "error": [None]})
                    except Exception as e:  # whatever the network does to one file
                        yield pd.DataFrame({"key": [row.key], "start": [row.start], "content": [None], "error": [f"{type(e).__name__}: {e}"]})

        return wanted.repartition(max(1, min(wanted.count(), 10_000)), "key").mapInPandas(run, FETCHED)


#: How a pack's source.type is read. Another transport is another entry.
TRANSPORTS = {"local-folder": LocalFolder(), "kudu": HttpFolder()}


def transport_of(pack: Pack):
    kind = pack.manifest["source"]["type"]
    if kind not in TRANSPORTS:
        raise ValueError(f"No transport for sources of type {kind}")
    return TRANSPORTS[kind]


@dataclass
class Listed:
    files: DataFrame | None = None
    error: str | None = None
    location: str | None = None


def list_service(spark: SparkSession, pack: Pack, service: dict, token: Callable | None, date_from: dt.date | None, date_to: dt.date | None) -> Listed:
    """The service's files at its location, the one set or the first of the pack's that has fitting files. Denied access is
    tried once more with a fresh token."""
    transport = transport_of(pack)
    if not service.get("endpoint"):
        return Listed(error="has no endpoint")
    known = [x for x in pack.locations if service.get("location") in (None, x.id)]
    for fresh in (False, True):
        bearer = token(fresh) if transport.needs_token and token is not None else None
        try:
            for location in known:
                try:
                    files = transport.list(spark, pack, service, location.dir, bearer)
                    fitting = catalog.files_for_range(files, location)
                    if service.get("location") is None and fitting.isEmpty():
                        continue
                except AccessDenied:
                    raise
                except Exception as e:
                    if service.get("location") is not None or len(known) == 1:
                        return Listed(error=f"{type(e).__name__}: {str(e).splitlines()[0]}")
                    continue  # the folder of a location that this service does not use
                files = catalog.files_for_range(files, location, date_from, date_to)
                key = F.concat_ws("/", F.lit(service["id"]), F.lit(location.id), "name")
                return Listed(files.select(key.alias("key"), F.lit(service["id"]).alias("service_id"), F.col("name").alias("file"), "path", "size", "mtime", "log_date", "instance"), location=location.id)
            return Listed(error="none of the pack's log locations has its files")
        except AccessDenied as e:
            denied = str(e)
            if not transport.needs_token or token is None:
                break
    return Listed(error=f"access denied: {denied}")


SUMMARY = "service_id string, listed long, fetched long, appended long, current long, failed long, bytes long, message string"


def sync(spark: SparkSession, services: Sequence[dict], registry: Registry, folder: str, today: dt.date, token: Callable | None = None, date_from: dt.date | None = None, date_to: dt.date | None = None) -> DataFrame:
    """Fetch what is new, changed or grown of the services' files into folder/chunks and folder/manifest; one summary row
    per service. Listings are small and driven from here; contents go from the executors to the store.

    services: dicts with id, pack_id, endpoint and location. Runs may be repeated: what was stored is not fetched again, and
    a file counts as stored only once its chunk is written. Files that fail are tried again, FILE_ATTEMPTS times in all,
    and are left as they were."""
    manifest, version = store.load_manifest(spark, f"{folder}/manifest")
    listed = {s["id"]: _listed(spark, registry, s, token, date_from, date_to) for s in services}
    outcome, wanted = [], []
    for s in services:
        found = listed[s["id"]]
        if found.error is not None:
            outcome.append((s["id"], 0, 0, 0, 0, 0, 0, found.error))
            continue
        wanted.append(found.files.withColumn("transport", F.lit(registry.get(s["pack_id"]).manifest["source"]["type"])))
    if not wanted:
        return spark.createDataFrame(outcome, SUMMARY)
    every = wanted[0]
    for more in wanted[1:]:
        every = every.unionByName(more)
    # One row per file: the plan of the run, which is fixed before anything is fetched.
    decided = catalog.sync_decisions(every, manifest.select("key", "size", "mtime"), today).join(manifest.select("key", F.col("size").alias("have")), "key", "left")
    plan = f"{folder}/runs/{version + 1}"
    decided.write.mode("overwrite").parquet(f"{plan}/decided")
    decided = spark.read.parquet(f"{plan}/decided")
    ranged = F.col("decision").isin("append", "probe")
    missing = decided.where("decision <> 'current'").withColumn("start", F.when(ranged, F.col("have")).otherwise(0).cast("long"))
    tokens = {s["id"]: token(False) for s in services if token is not None and s["id"] in listed and listed[s["id"]].error is None and transport_of(registry.get(s["pack_id"])).needs_token}
    chunks, lost, attempt = None, None, 0
    while attempt < FILE_ATTEMPTS and not missing.isEmpty():
        for kind, transport in TRANSPORTS.items():
            some = missing.where(F.col("transport") == kind)
            if some.isEmpty():
                continue
            path = f"{plan}/fetched-{attempt}-{kind}"
            got = transport.fetch(spark, some.select("key", "service_id", "path", "start", "size"), tokens)
            got.write.mode("overwrite").option("compression", "zstd").parquet(path)
            got = spark.read.schema(FETCHED).parquet(path)
            # A file counts as fetched if all its parts are.
            failed = got.where("error is not null").select("key", "error")
            whole = got.join(failed.select("key"), "key", "left_anti")
            chunks = whole if chunks is None else chunks.unionByName(whole)
            lost = failed if lost is None else lost.unionByName(failed)
        missing = missing.join(chunks.select("key"), "key", "left_anti")
        attempt += 1
    if chunks is not None:
        _store(spark, folder, version + 1, decided, chunks, manifest, registry, services)
        ok = chunks.groupBy("key").agg(F.sum(F.octet_length("content")).alias("got"), F.min("start").alias("start"))
        failed = lost.groupBy("key").agg(F.max("error").alias("error"))
    else:
        ok, failed = (spark.createDataFrame([], s) for s in ("key string, got long, start long", "key string, error string"))
    summary = summary_of(decided, ok, failed)
    empty = [(s["id"], 0, 0, 0, 0, 0, 0, "no file matched") for s in services if listed[s["id"]].error is None]
    none = spark.createDataFrame(empty, SUMMARY).join(summary.select("service_id"), "service_id", "left_anti")
    return summary.unionByName(none).unionByName(spark.createDataFrame(outcome, SUMMARY)).orderBy("service_id")


def summary_of(decided: DataFrame, ok: DataFrame, failed: DataFrame) -> DataFrame:
    """One row per service that has files. decided: service_id, key, decision, instance; ok: key, start, got (bytes fetched
    from start on); failed: key, error of attempts, which a later attempt may have made good."""
    judged = decided.join(ok, "key", "left").join(failed.join(ok.select("key"), "key", "left_anti"), "key", "left")
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    grown, got = F.col("start") > 0, F.col("got") > 0
    return judged.groupBy("service_id").agg(
        F.count(F.lit(1)).alias("listed"), count(F.col("got").isNotNull() & ~grown).alias("fetched"), count(grown & got).alias("appended"), count((F.col("decision") == "current") | (grown & ~got)).alias("current"),
        count(F.col("error").isNotNull()).alias("failed"), F.coalesce(F.sum("got"), F.lit(0)).cast("long").alias("bytes"),
        F.coalesce(F.max("error"), F.when(F.countDistinct("instance") > 1, F.lit("several instances write here"))).alias("message"),
    )


def _listed(spark, registry: Registry, service: dict, token, date_from, date_to) -> Listed:
    pack = registry.get(service.get("pack_id"))
    if pack is None:
        return Listed(error=f"its pack {service.get('pack_id')} is not loaded")
    try:
        return list_service(spark, pack, service, token, date_from, date_to)
    except Exception as e:
        return Listed(error=f"{type(e).__name__}: {str(e).splitlines()[0]}")


def _store(spark, folder: str, number: int, decided: DataFrame, chunks: DataFrame, manifest: DataFrame, registry: Registry, services: Sequence[dict]) -> None:
    """Write the run's chunks, then the manifest that counts them in."""
    versions = manifest.select("key", F.col("size").alias("__have"))
    new = chunks.join(decided.select("key", "service_id", "file", "log_date", "instance", "mtime"), "key").join(versions, "key", "left")
    # A server without ranges sends the whole file: that replaces what is stored, as a first chunk does.
    new = new.withColumn("fresh", F.col("start") == 0)
    path = f"{folder}/chunks/run={number}"
    new.where(F.col("fresh") | (F.octet_length("content") > 0)).select("service_id", "key", F.lit(number).cast("long").alias("version"), "fresh", "start", "content").write.mode("overwrite").option("compression", "zstd").parquet(path)
    formats = {s["id"]: registry.get(s["pack_id"]).timestamps for s in services if registry.get(s.get("pack_id"))}
    spans = spans_of(spark.read.parquet(path), formats)
    changes = new.join(spans, "key", "left").select("key", "service_id", "file", "log_date", "instance", F.octet_length("content").cast("long").alias("size"), "mtime", "first_ts", "last_ts", "fresh")
    names = manifest.columns
    kept = store.merge_manifest(manifest, changes.where("fresh").select(*names))
    store.save_manifest(store.merge_manifest(kept, changes.where("not fresh").select(*names), append=True), f"{folder}/manifest", number)


def spans_of(chunks: DataFrame, formats: dict[str, list]) -> DataFrame:
    """key, first_ts, last_ts of the chunks' headers, dated by the formats of each service's pack."""
    lines = chunks.select("service_id", "key", "start", F.posexplode(F.split(F.make_valid_utf8(F.col("content").cast("string")), "\n")).alias("at", "line"))
    ts = parse_by(F.col("service_id"), F.rtrim("line", F.lit("\r")), formats)
    rows = lines.select("key", F.struct("start", "at").alias("at"), ts.alias("ts")).where("ts is not null")
    return rows.groupBy("key").agg(F.min_by("ts", "at").alias("first_ts"), F.max_by("ts", "at").alias("last_ts"))


def current_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of each stored file since it was last fetched whole."""
    chunks = spark.read.parquet(f"{folder}/chunks")
    whole = chunks.where("fresh").groupBy("key").agg(F.max("version").alias("__whole"))
    return chunks.join(whole, "key").where(F.col("version") >= F.col("__whole")).drop("__whole")


def stored_files(spark: SparkSession, folder: str) -> DataFrame:
    """key, service_id, value: the text of every stored file, its chunks joined in order, one row for each; for files of any
    size see stored_lines."""
    joined = F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", F.hex("content").alias("hex")))), lambda c: c["hex"]), ""))
    return current_chunks(spark, folder).groupBy("key", "service_id").agg(joined.alias("content")).select("key", "service_id", F.col("content").cast("string").alias("value"))


def stored_lines(spark: SparkSession, folder: str, keys: DataFrame | None = None) -> DataFrame:
    """key, service_id, line_no (from 1), line of every stored file, or of those in `keys` (key). As split_lines of the whole
    text, but chunks are split where they lie: a line's number is its place in the chunk and the lines that end in earlier
    chunks, one row per chunk. Only the first and last piece of a chunk are shuffled, so that lines across a border, and
    characters too, are put together."""
    chunks = current_chunks(spark, folder)
    if keys is not None:
        chunks = chunks.join(keys.select("key").distinct(), "key", "left_semi")
    chunks = chunks.where(F.octet_length("content") > 0).select("key", "service_id", "start", F.col("content").cast("string").alias("text"))
    ends = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    place = store.shared_path(spark, "chunk-lines")
    chunks.select("key", "start", ends.cast("long").alias("ends")).write.parquet(place)
    counts = spark.read.schema("key string, start long, ends long").parquet(place)
    earlier = Window.partitionBy("key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    numbered = counts.withColumn("before", F.coalesce(F.sum("ends").over(earlier), F.lit(0)))
    numbered = F.broadcast(numbered) if counts.count() <= MOST_SENT else numbered.hint("merge")
    rows = chunks.join(numbered, ["key", "start"])
    parts = F.split(F.make_valid_utf8("text"), "\n")
    inner = rows.where("ends >= 2").select("key", "service_id", "before", F.posexplode(F.slice(parts, F.lit(2), F.size(parts) - 2)).alias("at", "line"))
    inner = inner.select("key", "service_id", (F.col("before") + F.col("at") + 2).alias("line_no"), "line")
    piece = lambda no, n, last: F.struct(no.alias("line_no"), F.lit(last).alias("last"), F.hex(F.substring_index("text", "\n", n)).alias("hex"))
    first, final = piece(F.col("before") + 1, 1, False), piece(F.col("before") + F.col("ends") + 1, -1, True)
    edges = rows.select("key", "service_id", "start", F.explode(F.when(F.col("ends") > 0, F.array(first, final)).otherwise(F.array(first))).alias("e"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "e.hex"))), lambda x: x["hex"]), "")
    edges = edges.groupBy("key", "service_id", F.col("e.line_no").alias("line_no")).agg(joined.alias("hex"), F.bool_and("e.last").alias("open"))
    # What follows a file's last line end is a line only if there is something.
    edges = edges.where("not open or hex <> ''").select("key", "service_id", "line_no", F.make_valid_utf8(F.unhex("hex").cast("string")).alias("line"))
    return inner.unionByName(edges).withColumn("line", F.rtrim("line", F.lit("\r")))


def file_parts(spark: SparkSession, folder: str, key: str) -> Iterator[bytes]:
    """The bytes of one stored file, as they were fetched, a chunk at a time."""
    chunks = spark.read.parquet(f"{folder}/chunks").where(F.col("key") == key)
    whole = chunks.where("fresh").agg(F.max("version")).first()[0]
    if whole is None:
        raise ValueError(f"{key} is not stored")
    for (content,) in chunks.where(F.col("version") >= whole).orderBy("version", "start").select("content").toLocalIterator():
        yield bytes(content)


def export_file(spark: SparkSession, folder: str, key: str) -> bytes:
    return b"".join(file_parts(spark, folder, key))


def delete_file(spark: SparkSession, folder: str, key: str) -> None:
    """The file is forgotten: the manifest's next version lacks it, so a later run fetches it anew."""
    manifest, version = store.load_manifest(spark, f"{folder}/manifest")
    store.save_manifest(catalog.forget(manifest, spark.createDataFrame([(key,)], "key string")), f"{folder}/manifest", version + 1)


def sync_and_export(spark: SparkSession, services: Sequence[dict], registry: Registry, folder: str, target: str, today: dt.date, date_from: dt.date, date_to: dt.date, token: Callable | None = None) -> DataFrame:
    """sync, then the text of the range's files and of undated ones under target/service=<id>/file=<name>. The summary has a
    message for services of which nothing could be exported."""
    summary = sync(spark, services, registry, folder, today, token, date_from, date_to)
    manifest, _ = store.load_manifest(spark, f"{folder}/manifest")
    ids = [s["id"] for s in services]
    files = manifest.where(F.col("service_id").isin(*ids)).select(F.col("key").alias("file_id"), "service_id", "file", "log_date")
    exported = files.where(F.col("log_date").isNull() | F.col("log_date").between(F.lit(date_from), F.lit(date_to)))
    if not exported.isEmpty():
        lines = stored_lines(spark, folder, exported.select(F.col("file_id").alias("key")))
        store.export_range(lines.select(F.col("key").alias("file_id"), "line_no", "line"), files, target, date_from, date_to)
    n = exported.groupBy("service_id").agg(F.count(F.lit(1)).alias("exported"))
    nothing = F.when(F.coalesce("exported", F.lit(0)) == 0, F.coalesce("message", F.lit("no stored file of the range"))).otherwise(F.col("message"))
    return summary.join(n, "service_id", "left").withColumn("message", nothing).withColumn("exported", F.coalesce("exported", F.lit(0))).orderBy("service_id")
