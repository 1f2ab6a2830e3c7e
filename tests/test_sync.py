import datetime as dt
import http.server
import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from loomlog.operators.lines import split_lines, to_entries
from loomlog.operators.search import Request
from loomlog.operators.result import search
from loomlog.plans import services
from loomlog.plans.config import Config
from loomlog.plans.packs import Registry
from loomlog.sources import http_vfs, store, sync

TODAY = dt.date(2026, 7, 24)
DATED = {"id": "core", "dir": "logs", "file": r"^log-(?<y>\d{4})-(?<m>\d{2})-(?<d>\d{2})(?:_(?<instance>\w+))?\.log$"}


def pack(name, kind, **more):
    source = {"type": kind} | ({"root": more.pop("root")} if "root" in more else {})
    return json.dumps({"id": name, "name": name.title(), "source": source, "logLocations": [DATED], "environments": [{"id": "test", "label": "Test"}]} | more)


class Folder(http.server.BaseHTTPRequestHandler):
    """A service's logs over HTTP. Files whose name is in `broken` fail; without the right token access is denied."""

    files, broken, token, asked = {}, set(), "good", []

    def do_GET(self):
        cls = type(self)
        if self.headers.get("Authorization") != f"Bearer {cls.token}":
            return self.send_error(401)
        name = self.path.rsplit("/", 1)[1]
        if not name:
            body = json.dumps([{"name": n, "size": len(b), "mtime": m, "mime": "text/plain"} for n, (b, m) in cls.files.items()]).encode()
            status = 200
        elif name in cls.broken:
            return self.send_error(404)
        else:
            start = int(self.headers.get("Range", "bytes=0-")[6:-1])
            cls.asked.append((name, start))
            body, status = cls.files[name][0][start:], 206 if start else 200
            if start and not body:
                return self.send_error(416)
        self.send_response(status)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


@pytest.fixture
def endpoint():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Folder)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Folder.files, Folder.broken, Folder.token, Folder.asked = {}, set(), "good", []
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_tokens_are_kept_until_shortly_before_their_end():
    now, given = [0.0], []
    token = sync.TokenSource(lambda: (given.append(1) or f"t{len(given)}", 3600), clock=lambda: now[0])
    assert [token(), token()] == ["t1", "t1"]
    now[0] = 3301.0
    assert token() == "t2" and token(fresh=True) == "t3"


def test_sync_over_http_and_a_folder(spark, tmp_path, endpoint):
    folder, root = str(tmp_path / "store"), tmp_path / "in"
    (root / "svc" / "logs").mkdir(parents=True)
    (root / "svc" / "logs" / "log-2026-07-20.log").write_bytes(b"2026-07-20T01:00:00Z local\n")
    (root / "svc" / "logs" / "other.txt").write_bytes(b"x")
    Folder.files = {
        "log-2026-07-23.log": (b"2026-07-23T10:00:00Z one\n  more\n2026-07-23T11:00:00Z two\n", "2026-07-23T11:00:00+00:00"),
        "log-2026-07-24.log": (b"2026-07-24T08:00:00Z live\n", "2026-07-24T08:00:00+00:00"),
        "log-2026-07-22.log": (b"lost", "2026-07-22T08:00:00+00:00"),
    }
    Folder.broken = {"log-2026-07-22.log"}
    registry = Registry.load([pack("web", "kudu"), pack("disk", "local-folder", root=str(root))])
    every = [
        {"id": "test/a", "pack_id": "web", "endpoint": endpoint, "location": None},
        {"id": "test/b", "pack_id": "disk", "endpoint": "svc", "location": "core"},
        {"id": "test/c", "pack_id": "gone", "endpoint": "x", "location": None},
        {"id": "test/d", "pack_id": "disk", "endpoint": "nowhere", "location": "core"},
        {"id": "test/e", "pack_id": "web", "endpoint": None, "location": None},
    ]
    # The first token is stale: access is denied once, then a fresh one is asked for.
    tokens = iter(["stale", *["good"] * 20])
    token = sync.TokenSource(lambda: (next(tokens), 3600))
    run = lambda: {r.service_id: r for r in sync.sync(spark, every, registry, folder, TODAY, token).collect()}
    rows = run()
    a = rows["test/a"]
    assert (a.listed, a.fetched, a.failed) == (3, 2, 1) and "404" in a.message and a.bytes == sum(len(Folder.files[n][0]) for n in list(Folder.files)[:2])
    assert (rows["test/b"].fetched, rows["test/b"].failed) == (1, 0)
    assert "not loaded" in rows["test/c"].message and rows["test/d"].message and "endpoint" in rows["test/e"].message
    manifest, _ = store.load_manifest(spark, f"{folder}/manifest")
    held = {r.file: r for r in manifest.where("service_id = 'test/a'").collect()}
    assert held["log-2026-07-23.log"].last_ts == dt.datetime(2026, 7, 23, 11) and held["log-2026-07-23.log"].first_ts == dt.datetime(2026, 7, 23, 10)

    # What is stored is not asked for again; the live file is asked for what lies beyond; the broken one is tried again.
    Folder.files["log-2026-07-24.log"] = (Folder.files["log-2026-07-24.log"][0] + b"2026-07-24T09:00:00Z more\n", "2026-07-24T09:00:00+00:00")
    Folder.broken, Folder.asked = set(), []
    rows = run()
    assert sorted(Folder.asked) == [("log-2026-07-22.log", 0), ("log-2026-07-24.log", 26)]
    assert (rows["test/a"].fetched, rows["test/a"].appended, rows["test/a"].current, rows["test/a"].failed) == (1, 1, 1, 0)
    assert rows["test/b"].current == 1
    key = "test/a/core/log-2026-07-24.log"
    assert sync.export_file(spark, folder, key) == Folder.files["log-2026-07-24.log"][0]
    texts = {r.key: r.value for r in sync.stored_files(spark, folder).collect()}
    assert texts[key].encode() == Folder.files["log-2026-07-24.log"][0] and len(texts) == 4
    grown = {r.key: r for r in store.load_manifest(spark, f"{folder}/manifest")[0].collect()}[key]
    assert (grown.size, grown.first_ts, grown.last_ts) == (52, dt.datetime(2026, 7, 24, 8), dt.datetime(2026, 7, 24, 9))

    # Nothing new on the live file: current. A rewritten file takes the old one's place. A deleted one is fetched anew.
    Folder.files["log-2026-07-23.log"] = (b"2026-07-23T12:00:00Z new\n", "2026-07-24T10:00:00+00:00")
    sync.delete_file(spark, folder, "test/b/core/log-2026-07-20.log")
    rows = run()
    assert (rows["test/a"].fetched, rows["test/a"].current, rows["test/b"].fetched) == (1, 2, 1)
    assert sync.export_file(spark, folder, "test/a/core/log-2026-07-23.log") == b"2026-07-23T12:00:00Z new\n"
    with pytest.raises(ValueError, match="not stored"):
        sync.export_file(spark, folder, "none")

    out = str(tmp_path / "out")
    summary = {r.service_id: r for r in sync.sync_and_export(spark, every, registry, folder, out, TODAY, dt.date(2026, 7, 23), dt.date(2026, 7, 23), token).collect()}
    assert summary["test/a"].exported == 1 and (summary["test/b"].exported, summary["test/b"].message) == (0, "no file matched")
    exported = spark.read.option("recursiveFileLookup", "true").text(out).collect()
    assert [r.value for r in exported] == ["2026-07-23T12:00:00Z new"]


class Breaking(http.server.BaseHTTPRequestHandler):
    """A file whose connections break after `lasts` bytes, from a server with or without ranges."""

    content, lasts, ranges, asked = b"", 0, True, []

    def do_GET(self):
        cls = type(self)
        start = int(self.headers.get("Range", "bytes=0-")[6:-1])
        cls.asked.append(start)
        body = cls.content[start:] if cls.ranges else cls.content
        self.send_response(206 if start and cls.ranges else 200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body[: cls.lasts] if cls.lasts else body)
        self.close_connection = True

    def log_message(self, *a):
        pass


def test_http_files_come_in_parts(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Breaking)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url, mb = f"http://127.0.0.1:{server.server_port}/f", 1 << 20
    rng = random.Random(4)
    Breaking.content = b"".join(rng.randbytes(rng.randint(1, 3000)).replace(b"\n", b" ") + b"\n" for _ in range(4000)) + b"no end"
    size = len(Breaking.content)
    get = lambda start=0: list(http_vfs.fetch_parts(url, None, start, lambda s: None, part_bytes=mb))
    for ranges, lasts, start in ((True, 0, 0), (True, 0, 1234), (True, size // 2 + 1, 0), (True, size // 2 + 1, 77), (False, 0, 0), (False, 0, 1234)):
        Breaking.ranges, Breaking.lasts, Breaking.asked = ranges, lasts, []
        parts = get(start)
        begin = start if ranges else 0
        assert len(parts) >= 3 and parts[0][0] == begin and b"".join(p for _, p in parts) == Breaking.content[begin:]
        assert all(a + len(p) == b for (a, p), (b, _) in zip(parts, parts[1:])) and all(p.endswith(b"\n") and len(p) <= 2 * mb for _, p in parts[:-1])
        assert len(Breaking.asked) == (2 if lasts else 1)
    # Without ranges, after parts have been given: the second answer's beginning is skipped.
    Breaking.ranges, Breaking.lasts = False, 3 * mb
    taken = http_vfs.fetch_parts(url, None, 0, lambda s: setattr(Breaking, "lasts", 0), part_bytes=mb)
    parts = list(taken)
    assert b"".join(p for _, p in parts) == Breaking.content and [a for a, _ in parts] == sorted({a for a, _ in parts})
    Breaking.lasts = mb // 2
    with pytest.raises(RuntimeError, match="3 attempts"):
        get()
    # A line of several parts' length is cut; a file's end gives one empty part.
    Breaking.ranges, Breaking.lasts, Breaking.content = True, 0, b"x" * (9 * mb)
    assert [len(p) for _, p in get()] == [4 * mb, 4 * mb, mb] and get(0)[0][0] == 0
    Breaking.content = b""
    assert get() == [(0, b"")]
    server.shutdown()


def test_stored_lines_equal_those_of_the_whole_text(spark, tmp_path, monkeypatch):
    """Chunks that end anywhere: within lines, within characters, at line ends, and lines over several chunks."""
    rng = random.Random(3)
    parts = ["\n", "\n", "\r\n", "a", "é", "😀", "word ", "\n\n", "x" * 40]
    texts = {f"k{k}": "".join(rng.choice(parts) for _ in range(rng.randint(0, 30))).encode() for k in range(60)} | {"end": b"a\n", "two": b"a\n\n", "bad": b"\xff\n\xc3", "one": b"no end"}
    rows = []
    for key, content in texts.items():
        cuts = sorted({0, len(content), *(rng.randint(0, len(content)) for _ in range(rng.randint(0, 6)))})
        rows.append(("s", key, 1, True, 0, b"an older version\n"))
        rows += [("s", key, 2 + (a > 0), a == 0, a, content[a:b]) for a, b in zip(cuts, cuts[1:] or [0])]
    folder = str(tmp_path / "store")
    spark.createDataFrame(rows, "service_id string, key string, version long, fresh boolean, start long, content binary").repartition(5).write.parquet(f"{folder}/chunks")
    whole = spark.createDataFrame([(k, bytearray(v)) for k, v in texts.items()], "key string, content binary").select("key", F.col("content").cast("string").alias("value"))
    want = {(r.key, r.line_no): r.line for r in split_lines(whole, key="key").collect()}
    for most in (sync.MOST_SENT, 0):
        monkeypatch.setattr(sync, "MOST_SENT", most)
        got = sync.stored_lines(spark, folder).collect()
        assert len(got) == len(want) and {(r.key, r.line_no): r.line for r in got} == want
    some = sync.stored_lines(spark, folder, spark.createDataFrame([("two",), ("two",), ("none",)], "key string"))
    assert sorted((r.line_no, r.line) for r in some.collect()) == [(1, "a"), (2, "")]


def test_fields_and_formats_are_those_of_the_service_pack(spark):
    field = lambda key: {"key": key, "regex": r"took (\d+)", "type": "number"}
    stamp = {"regex": r"^(?<H>\d+)h(?<M>\d+) (?<S>\d+) (?<d>\d+)\.(?<m>\d+)\.(?<y>\d+)"}
    registry = Registry.load([pack("one", "local-folder", fields=[field("ms")]), pack("two", "local-folder", fields=[field("sec")], timestamps=[stamp])])
    texts = [(1, "one", "2026-07-20T01:00:00Z took 5\n12h30 1 20.7.2026 took 6"), (2, "two", "12h30 1 20.7.2026 took 7\n2026-07-20T01:00:00Z took 8"), (3, "gone", "2026-07-20T01:00:00Z took 9")]
    files = spark.createDataFrame([(f, p, f"s{f}", f"f{f}") for f, p, _ in texts], "file_id long, pack_id string, service_id string, file string")
    lines = split_lines(spark.createDataFrame([(f, t) for f, _, t in texts], "file_id long, value string")).join(files.select("file_id", "pack_id"), "file_id")
    entries = to_entries(lines, {p.id: p.timestamps for p in registry.packs}).drop("pack_id")
    rows = {(r.file_id, r.line_no): r for r in search(entries, files, Request("took"), registry.fields()).hits.collect()}
    assert {k: (r["one.ms"], r["two.sec"]) for k, r in rows.items()} == {(1, 1): (5, None), (2, 1): (None, 7), (3, 1): (None, None)}
    assert rows[2, 1].ts == dt.datetime(2026, 7, 20, 12, 30, 1)


def test_services_by_hand():
    registry = Registry.load([pack("web", "kudu"), pack("disk", "local-folder")])
    config = Config(services=[{"id": "test/old", "pack_id": "web", "source": "scraped", "endpoint": "https://o"}], environments=[{"id": "mine"}])
    added = services.add(config, registry, " New ", "mine", "web", "n.example/")
    assert added["endpoint"] == "https://n.example" and [s["id"] for s in config.services] == ["mine/New", "test/old"]
    services.set_endpoint(config, registry, "test/old", "")
    services.set_location(config, registry, "test/old", "core")
    old = config.services[1]
    assert old["endpoint"] is None and old["endpoint_manual"] and old["location"] == "core"
    services.set_location(config, registry, "test/old", " ")
    assert old["location"] is None
    for bad, message in (
        (lambda: services.add(config, registry, "New", "mine", "web", "x"), "already"),
        (lambda: services.add(config, registry, "N", "nowhere", "web", "x"), "no environment"),
        (lambda: services.add(config, registry, "N", "mine", "gone", "x"), "no pack"),
        (lambda: services.remove(config, "test/old"), "discovery"),
        (lambda: services.remove(config, "x"), "no service"),
        (lambda: services.set_location(config, registry, "test/old", "zz"), "no log location"),
    ):
        with pytest.raises(ValueError, match=message):
            bad()
    services.remove(config, "mine/New")
    assert [s["id"] for s in config.services] == ["test/old"]
