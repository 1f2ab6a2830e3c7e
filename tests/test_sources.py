import datetime as dt
import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from loomlog.functions.regexes import translate
from loomlog.operators.lines import read_lines, split_lines
from loomlog.plans.packs import Location, PackError, Registry, compile_pack
from loomlog.sources import catalog
from loomlog.sources.discovery import scrape
from loomlog.sources.http_vfs import AccessDenied, HttpVfsSource, fetch, list_folder
from loomlog.streaming.growing import day_segments, follow, prefix_cut

DATED = Location("core", "Core", "applogs", translate(r"^log-(?<y>\d{4})-(?<m>\d{2})-(?<d>\d{2})(?:_(?<instance>\w+))?\.log$"), True)
GROWING = Location("app", "App", "App_Data", translate(r"(?i)^Log\.txt$"), False)


def pack(**more):
    return json.dumps({"id": "demo", "name": "Demo", "source": {"type": "local-folder"}} | more)


@pytest.mark.parametrize(
    "more, message",
    [
        ({"id": "Bad Id"}, "id"),
        ({"name": " "}, "name"),
        ({"source": None}, "source"),
        ({"extra": 1}, "unknown key extra"),
        ({"logLocations": [{"id": "a", "dir": "x", "file": r"(?<y>\d+)"}]}, "lacks the groups"),
        ({"timestamps": [{"regex": r"(?<y>\d+)"}]}, "lacks the groups"),
        ({"timestamps": ["nope"]}, "not one of"),
        ({"fields": [{"key": "a", "regex": "x"}]}, "no group"),
        ({"fields": [{"key": "a", "regex": "(x)", "gate": ""}]}, "gate"),
        ({"fields": [{"key": "a", "regex": "(x)"}, {"key": "a", "regex": "(y)"}]}, "duplicate"),
        ({"fields": [{"key": f"k{i}", "regex": "(x)"} for i in range(33)]}, "more than the 32"),
        ({"charts": [{"name": "c", "metric": "avg"}]}, "works on a number"),
        ({"charts": [{"name": "c", "groupBy": "field:none"}]}, "no field"),
        ({"charts": [{"name": "c", "metric": "sum", "value": "field:a"}], "fields": [{"key": "a", "regex": "(x)"}]}, "holds no numbers"),
        ({"charts": [{"name": "c", "groupBy": "custom"}]}, "customRegex"),
        ({"discovery": {"type": "scrape", "url": "ftp://x", "container": "(?<name>x)"}}, "http"),
        ({"discovery": {"type": "scrape", "url": "http://x", "container": "x"}}, "name"),
        ({"discovery": {"type": "static", "services": [{"name": "a", "environment": "zz"}]}}, "names no environment"),
    ],
)
def test_packs_are_checked(more, message):
    with pytest.raises(PackError, match=message):
        compile_pack(pack(**more))


def test_registry_replaces_and_unites(tmp_path):
    (tmp_path / "a.json").write_text(pack(name="Mine", environments=[{"id": "test", "label": "T2"}, {"id": "prod", "label": "P"}], presets=[{"name": "E", "query": "x"}]))
    (tmp_path / "b.json").write_text("{")
    other = pack(id="other", environments=[{"id": "test", "label": "T1"}], fields=[{"key": "ms", "regex": r"(\d+)ms", "type": "number"}])
    r = Registry.load([pack(), other], str(tmp_path))
    assert [p.manifest["name"] for p in r.packs] == ["Mine", "Demo"] and "b.json" in r.errors
    assert r.environments() == [("test", "T2"), ("prod", "P")] and [f.key for f in r.fields()] == ["other.ms"]
    assert r.presets()[0]["name"] == "Mine: E"
    assert [p.id for p in Registry.load([pack(), other], disabled=["demo"]).packs] == ["other"]


def test_files_of_a_location(spark):
    names = ["log-2026-07-13.log", "log-2026-07-14_a1.log", "log-2026-02-30.log", "other.txt", "log.txt"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    found = catalog.files_for_range(df, DATED, dt.date(2026, 7, 13), dt.date(2026, 7, 14)).collect()
    assert [(r.name, r.log_date, r.instance) for r in found] == [(names[0], dt.date(2026, 7, 13), None), (names[1], dt.date(2026, 7, 14), "a1")]
    assert [r.name for r in catalog.files_for_range(df, GROWING).collect()] == ["log.txt"]
    listed = df.withColumn("dir", F.lit("/AppLogs/"))
    assert catalog.detect_location(listed, [GROWING, DATED]) == "core" and catalog.detect_location(df.withColumn("dir", F.lit("x")), [DATED]) is None
    with pytest.raises(ValueError):
        catalog.resolve_root("/logs", "../etc")
    assert catalog.resolve_root("/logs", "a/b") == "/logs/a/b" and catalog.resolve_root("/logs", "/x") == "/x"


def manifest(spark, rows):
    names = [c.split()[0] for c in catalog.MANIFEST.split(", ")]
    return spark.createDataFrame([tuple(r.get(n, {"service_id": "s"}.get(n)) for n in names) for r in rows], catalog.MANIFEST)


def test_clock_is_the_median_to_a_quarter(spark):
    def offset(*pairs):
        rows = [{"key": f"k{i}", "mtime": m, "last_ts": t} for i, (m, t) in enumerate(pairs)]
        return [r.offset_minutes for r in catalog.clock_offsets(manifest(spark, rows)).collect()]

    noon = dt.datetime(2026, 7, 14, 12)
    at = lambda minutes, seconds=0: (noon, noon + dt.timedelta(minutes=minutes, seconds=seconds))
    assert offset(at(0, -30)) == [0] and offset(at(120, -10)) == [120] and offset(at(0), at(0), at(600)) == [0]
    assert offset(at(2000)) == [] and offset(at(-330, 5)) == [-330]


def test_gaps_are_whole_days(spark):
    day = lambda d, h, m, s: dt.datetime(2026, 7, d, h, m, s)
    rows = [{"key": "a", "first_ts": day(15, 1, 0, 0), "last_ts": day(15, 21, 14, 9)}, {"key": "b", "first_ts": day(17, 5, 30, 12), "last_ts": day(17, 6, 0, 0)}]
    assert [(r.gap_from, r.gap_to) for r in catalog.coverage_gaps(manifest(spark, rows)).collect()] == [(day(15, 21, 14, 9), day(17, 5, 30, 12))]
    rows = [{"key": "a", "log_date": dt.date(2026, 7, 13)}, {"key": "b", "log_date": dt.date(2026, 7, 16)}]
    assert catalog.coverage_gaps(manifest(spark, rows)).first().gap_from == day(13, 23, 59, 59)


def test_scraped_services_keep_to_their_block(spark):
    html = '<h2>TEST</h2><svc n="One" s="Test env"><a href="https://one">x</a><a dir="AppLogs">y</a><svc n="Two" s="Live"><svc n="Three" s="odd"><a href="https://three">z</a>'
    container = translate('<svc n="(?<name>[^"]*)" s="(?<section>[^"]*)">')
    rows = scrape(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string"), container, translate('href="(https://[^"]*)"'), translate('dir="(?<dir>[^"]*)"'), [("test", "t"), ("live", "p")], "d", [DATED]).orderBy("position").collect()
    assert [(r.name, r.environment, r.endpoint, r.location) for r in rows] == [("One", "t", "https://one", "core"), ("Two", "p", None, None), ("Three", "d", "https://three", None)]


class Stub(http.server.BaseHTTPRequestHandler):
    content, failures, ranges = b"0123456789" * 10, 0, True

    def do_GET(self):
        cls = type(self)
        if self.path.endswith("/denied/"):
            return self.send_error(403)
        if self.path.endswith("/logs/"):
            body = json.dumps([{"name": "a.log", "size": 100, "mime": "text/plain"}, {"name": "sub", "mime": "inode/directory"}]).encode()
            self.send_response(200)
        else:
            if cls.failures:
                cls.failures -= 1
                return self.send_error(503)
            start = int(self.headers.get("Range", "bytes=0-")[6:-1]) if cls.ranges else 0
            if start >= len(cls.content):
                return self.send_error(416)
            body = cls.content[start:]
            self.send_response(206 if start else 200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


@pytest.fixture
def endpoint():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Stub.failures, Stub.ranges = 0, True
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_http_ranges_retries_and_denial(spark, endpoint):
    url = f"{endpoint}/api/vfs/logs/a.log"
    assert fetch(url, start=95) == (95, b"56789") and fetch(url, start=100) == (100, b"")
    Stub.failures = 2
    assert fetch(url, pause=lambda s: None)[1] == Stub.content
    Stub.failures = 3
    with pytest.raises(RuntimeError, match="3 attempts"):
        fetch(url, pause=lambda s: None)
    Stub.failures, Stub.ranges = 0, False
    assert fetch(url, start=95) == (0, Stub.content)
    with pytest.raises(AccessDenied):
        list_folder(endpoint, "denied")
    Stub.ranges = True
    spark.dataSource.register(HttpVfsSource)
    read = spark.read.format("http_vfs").option("endpoint", endpoint).option("folder", "logs").option("offsets", '{"a.log": 98}').load()
    assert [tuple(r) for r in read.collect()] == [("a.log", 98, b"89")]


def test_compressed_files_are_read(spark, tmp_path):
    import zstandard

    c = zstandard.ZstdCompressor()
    (tmp_path / "a.log.zst").write_bytes(c.compress(b"one\r\ntwo\n") + c.compress(b"three\n"))
    assert [r.line for r in read_lines(spark, [str(tmp_path / "a.log.zst")]).orderBy("line_no").collect()] == ["one", "two", "three"]


def test_only_a_beginning_is_cut(spark):
    day = lambda h: dt.datetime(2026, 7, 14, h)
    rows = [(1, 1, None), (1, 2, day(11)), (1, 3, None), (1, 4, day(13)), (1, 5, day(10)), (2, 1, day(9))]
    lines = spark.createDataFrame([(f, n, t, day(12)) for f, n, t in rows], "file_id long, line_no long, ts timestamp_ntz, cut timestamp_ntz")
    assert [r.line_no for r in prefix_cut(lines).orderBy("line_no").collect()] == [4, 5]
    days = {(r.file_id, r.line_no): r.log_date for r in day_segments(lines.drop("cut")).collect()}
    assert days[1, 1] == dt.date(2026, 7, 14)


def test_growing_file_is_stored_once(spark, tmp_path):
    log, target = tmp_path / "in" / "Log.txt", tmp_path / "out"
    log.parent.mkdir()

    def sync():
        q = follow(spark, str(log.parent / "*.txt"), str(target), str(tmp_path / "ck"))
        assert q.awaitTermination(120)
        rows = spark.read.parquet(str(target / "segments")).orderBy("batch", "line_no").collect()
        return [(str(r.log_date), r.line) for r in rows]

    log.write_bytes(b"lead\n14.07.2026 23:59:58 a\n  more\n15.07.2026 00:00:01 b\nunfinis")
    first = [("2026-07-14", "lead"), ("2026-07-14", "14.07.2026 23:59:58 a"), ("2026-07-14", "  more"), ("2026-07-15", "15.07.2026 00:00:01 b")]
    assert sync() == first
    with log.open("ab") as f:
        f.write(b"hed\n15.07.2026 00:00:02 c\n")
    second = first + [("2026-07-15", "unfinished"), ("2026-07-15", "15.07.2026 00:00:02 c")]
    assert sync() == second
    log.write_bytes(b"15.07.2026 00:00:02 c\n15.07.2026 00:00:03 d\n")  # rotated: its beginning is stored already
    assert sync() == second + [("2026-07-15", "15.07.2026 00:00:03 d")]
