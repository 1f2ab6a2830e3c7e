import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from loomlog.functions.highlight import highlight, highlighted
from loomlog.operators.lines import raw_search, split_lines
from loomlog.operators.result import sorted_rows
from loomlog.plans import config, dates
from loomlog.plans.packs import Location, Pack
from loomlog.plans.query_tree import Criterion, Group, colour, compile_tree, legend, parse, to_regex
from loomlog.sources import catalog, store

DAY = dt.date(2026, 7, 24)


def test_presets_and_zones():
    assert dates.preset("yesterday", DAY) == (dt.date(2026, 7, 23),) * 2 and dates.preset("last7", DAY) == (dt.date(2026, 7, 18), DAY)
    assert dates.preset("thisMonth", DAY) == (dt.date(2026, 7, 1), DAY)
    assert [dates.zone_label(m) for m in (0, 120, -210)] == ["UTC", "UTC+2", "UTC-3:30"]
    at = lambda h: dt.datetime(2026, 7, 24, h)
    assert dates.time_window((DAY, DAY), at(9), None, "Europe/Prague") == (dt.datetime(2026, 7, 24, 7), dt.datetime(2026, 7, 24, 21, 59, 59, 999999))
    with pytest.raises(ValueError, match="before it begins"):
        dates.time_window((DAY, DAY), at(10), at(9))
    with pytest.raises(ValueError, match="outside the chosen"):
        dates.time_window((DAY, DAY), dt.datetime(2026, 7, 25), None)


def test_highlight_spans(spark):
    assert highlight("WARN then ERROR", "(?<err>ERROR)|(?<warn>WARN)", case_sensitive=True) == [("WARN", [2]), (" then ", []), ("ERROR", [1])]
    assert highlight("a\nxab", "ab", False) == [("a", []), ("\n", []), ("x", []), ("ab", [0])]
    assert highlight("10ms", "^(?=.*?(?<a>\\d+ms))(?=.*?(?<b>\\d+ms))") == [("10ms", [1, 2])]
    assert highlight("foo", "(?<a>foo)", off=["a"]) == [("foo", [])] and highlight("x", "(") == [("x", [])]
    assert sum(s == [0] for _, s in highlight("a" * 300, "a", False)) == 200
    df = spark.createDataFrame([("x foo",), (None,)], "t string").select(highlighted(F.col("t"), "foo", False).alias("p"))
    assert [[(p.text, p.slots) for p in r.p] if r.p else None for r in df.collect()] == [[("x ", []), ("foo", [0])], None]


def test_config(tmp_path):
    path = str(tmp_path / "c.json")
    config.Config(services=[{"name": "a"}], max_hits=5, memory_mb=1).save(path)
    c = config.Config.load(path, "kudu")
    assert (c.max_hits, c.memory_mb, c.services[0]["pack_id"]) == (100_000, 64, "kudu")
    (tmp_path / "c.json").write_text("{")
    assert config.Config.load(path).max_hits == 2_000_000
    assert config.slug(" Pre Prod! ") == "pre-prod" and config.service_id("test", "Web") == "test/Web" and config.endpoint("x.net/", "kudu") == "https://x.net"
    for bad in (lambda: config.slug("!"), lambda: config.service_id("t", "../x"), lambda: config.endpoint("http://x", "kudu")):
        with pytest.raises(ValueError):
            bad()


def test_manifest_versions(spark, tmp_path):
    path = str(tmp_path / "m")
    assert store.load_manifest(spark, path)[1] == 0
    row = lambda k, size, first, last: (k, "s", "f", None, None, size, None, first, last)
    t = lambda h: dt.datetime(2026, 7, 24, h)
    store.save_manifest(spark.createDataFrame([row("a", 1, t(1), t(2)), row("b", 1, None, None)], store.MANIFEST), path, 1)
    held, version = store.load_manifest(spark, path)
    more = spark.createDataFrame([row("a", 5, t(2), t(4))], store.MANIFEST)
    store.save_manifest(store.merge_manifest(held, more, append=True), path, version + 1)
    rows = {r.key: r for r in store.load_manifest(spark, path)[0].collect()}
    assert (rows["a"].size, rows["a"].first_ts, rows["a"].last_ts, rows["b"].size) == (6, t(1), t(4), 1)
    assert {r.key: r.size for r in store.merge_manifest(held, more).collect()} == {"a": 5, "b": 1}


def test_memory_tier_counts_bytes_and_keeps_pinned_tables(spark):
    table = lambda k: lambda: spark.range(20_000).select((F.col("id") * 7919 + k).alias("a"))
    probe = store.MemoryTier(1 << 30)
    probe.get(("p", 1), table(1))
    one = probe.stats()["bytes"]
    assert 20_000 < one < 2_000_000 and probe.stats()["tables"] == 1
    probe.clear()
    assert probe.stats()["bytes"] == 0
    tier = store.MemoryTier(int(one * 2.5))
    first, second = tier.get(("a", 1), table(1)), tier.get(("a", 2), table(2))
    assert tier.get(("a", 1), lambda: None) is first and first.storageLevel.useMemory and second.storageLevel.useMemory
    tier.get(("a", 3), table(3))
    assert list(tier.held) == [("a", 1), ("a", 3)] and not second.storageLevel.useMemory
    with tier.pinned(("a", 1), ("a", 4)), tier.pinned(("a", 1)):
        tier.get(("a", 4), table(4))
        tier.set_limit(1)
        assert set(tier.held) == {("a", 1), ("a", 4)} and tier.stats()["pinned"] == 2 and first.storageLevel.useMemory
        tier.clear()
        assert first.storageLevel.useMemory
    assert not tier.held and not tier.pins and not first.storageLevel.useMemory
    alone = tier.get(("a", 5), table(5))
    assert not tier.held and not alone.storageLevel.useMemory and alone.count() == 20_000


def test_lossy_text_and_raw_search(spark):
    rows = split_lines(spark.createDataFrame([(1, bytearray(b"ok\n\xffbad\xc3\n" + b"x" * 600 + b" end"))], "file_id long, value binary").withColumn("value", F.col("value").cast("string")))
    assert [r.line for r in rows.orderBy("line_no").collect()] == ["ok", "\ufffdbad\ufffd", "x" * 600 + " end"]
    total, first = raw_search(rows, F.col("line").contains("end"))
    assert total.first().total == 1 and [(r.line_no, r.line) for r in first.collect()] == [(3, "x" * 500)]
    assert raw_search(rows, None)[0].first().total == 0


def test_order_of_stored_files_and_location_by_folder(spark):
    rows = [("k1", "s", "b.txt", None), ("k2", "s", "b.txt", DAY), ("k3", "s", "a.txt", DAY), ("k4", "s", "z.txt", dt.date(2026, 7, 25)), ("k5", "s", "a.txt", None)]
    held = spark.createDataFrame(rows, "key string, service_id string, file string, log_date date")
    assert [r.key for r in catalog.stored_files(held).collect()] == ["k4", "k3", "k2", "k5", "k1"]
    places = [Location(name, name, folder, None, True) for name, folder in (("Application", "LogFiles/App"), ("http", "/LogFiles/http/"))]
    pack = Pack({"id": "p"}, places, [], [])
    assert pack.location_by_dir("/logfiles/APP/").id == "Application" and pack.location_by_dir("LogFiles/http").id == "http"
    assert pack.location_by_dir("LogFiles") is None


def test_export_and_stopping(spark, tmp_path):
    lines = split_lines(spark.createDataFrame([(1, "a\nb\nc"), (2, "x"), (3, "u")], "file_id long, value string"))
    files = spark.createDataFrame([(1, "s", "one", DAY), (2, "s", "two", dt.date(2026, 1, 1)), (3, "s", "three", None)], "file_id long, service_id string, file string, log_date date")
    store.export_range(lines, files, str(tmp_path / "out"), DAY, DAY)
    assert [r.value for r in spark.read.text(str(tmp_path / "out/service=s/file=one")).collect()] == ["a", "b", "c"]
    assert sorted(p.name for p in (tmp_path / "out/service=s").iterdir()) == ["file=one", "file=three"]
    with store.cancellable(spark, "job"):
        assert "job" in spark.getTags()
    store.cancel(spark, "job")


def test_files_view_sort_and_legend(spark):
    files = spark.createDataFrame([("k1", "s1", "App.log", 5), ("k2", "s2", "b.txt", 7), ("k3", "s3", "c.txt", 9)], "key string, service_id string, file string, size long")
    known = spark.createDataFrame([("s1", "Web", "test"), ("s2", "Backend", "test"), ("s3", "Web", "prod")], "service_id string, name string, environment string")
    keys = lambda **how: {r.key for r in catalog.visible_files(files, known, **how).collect()}
    assert keys() == {"k1", "k2", "k3"} and keys(environment="test") == {"k1", "k2"} and keys(needle="APP") == {"k1"} and keys(needle="web") == {"k1", "k3"}
    assert keys(environment="test", service_ids=["s2", "s3"]) == {"k2"}
    assert catalog.total_bytes(catalog.visible_files(files, known, environment="test")).first().bytes == 12
    rows = spark.createDataFrame([("b", 2.0), ("A", None), (None, 10.0), ("a", 3.0)], "name string, n double")
    assert [r.name for r in sorted_rows(rows, "name").collect()] == ["A", "a", "b", None] and [r.n for r in sorted_rows(rows, "n", False).collect()] == [10, 3, 2, None]
    tree = Group("all", [Criterion("x"), Group("any", [Criterion("a", label="one"), Criterion("b", "notContains")]), Group("any", [Criterion("c", disabled=True)]), Group("all", [Group("any", [Criterion("d")])], label="Mine")])
    assert legend(tree) == [{"label": "Set 1", "colour": 1, "names": ["one"]}, {"label": "Mine", "colour": 3, "names": ["g3"]}, {"label": "Set 4", "colour": 4, "names": ["g3"]}]
    assert [colour(k) for k in (1, 8, 9)] == [1, 8, 1]


SHAPES = [
    (Group("all", []), ""),
    (Group("all", [Criterion("a", "notContains")]), "^(?!.*a)"),
    (Group("any", [Criterion("a.b")]), r"(?<g1>a\.b)"),
    (Group("any", [Criterion("a"), Criterion("b", label="B b")]), "(?<g1>a)|(?<B_b>b)"),
    (Group("all", [Criterion("a"), Criterion("b", "regex")]), "^(?=.*?(?<g1>a))(?=.*?(?<g2>b))"),
    (Group("all", [Criterion("a"), Criterion("n", "notRegex")]), "^(?!.*n)(?=.*?(?<g1>a))"),
    (Group("all", [Group("any", [Criterion("a"), Criterion("b")]), Criterion("c")]), "^(?:(?=.*a)|(?=.*b))(?=.*c)(?=(?:(?=.*a)|(?=.*b))(?=.*c)(?=.*?(?<g1>a)|)(?=.*?(?<g2>b)|)(?=.*?(?<g3>c)|)|)"),
    (Group("any", [Group("all", [Criterion("a"), Criterion("b")]), Criterion("c")]), "^(?:(?=.*a)(?=.*b)|(?=.*c))(?=(?=.*a)(?=.*b)(?=.*?(?<g1>a)|)(?=.*?(?<g2>b)|)|)(?=.*?(?<g3>c)|)"),
    (Group("any", [Criterion("a"), Criterion("b"), Criterion("n", "notContains")]), "^(?!.*n)(?:(?=.*a)|(?=.*b))(?=.*?(?<g1>a)|)(?=.*?(?<g2>b)|)"),
]


@pytest.mark.parametrize("tree, text", SHAPES)
def test_shapes_of_saved_queries(tree, text):
    assert to_regex(tree) == text and to_regex(parse(text)) == text


def test_random_trees_as_text_and_as_columns_agree(spark):
    """A tree's text, run as a pattern, and its Columns take the same lines and colour the same groups."""
    rng = random.Random(3)

    def tree(depth=0):
        if depth == 3 or rng.random() < 0.4:
            return Criterion(rng.choice("abcd"), rng.choice(["contains"] * 4 + ["notContains"]), disabled=rng.random() < 0.1)
        return Group(rng.choice(["all", "any"]), [tree(depth + 1) for _ in range(rng.randint(0, 3))], disabled=rng.random() < 0.05)

    texts = ["".join(c for k, c in enumerate("abcd") if n >> k & 1) for n in range(16)]
    lines = spark.createDataFrame([(t,) for t in texts], "line string").coalesce(1)
    for _ in range(25):
        root = Group(rng.choice(["all", "any"]), [tree(1) for _ in range(rng.randint(1, 3))])
        compiled, pattern = compile_tree(root, F.col("line"), True), re.compile(to_regex(root).replace("(?<g", "(?P<g"))
        flags = F.array(*[f for _, f in compiled.flags]) if compiled.flags else F.array().cast("array<boolean>")
        for r in lines.select("line", (compiled.line & ~compiled.veto).alias("ok"), flags.alias("flags")).collect():
            m = pattern.search(r.line)
            assert (m is not None) == r.ok
            if m is not None and to_regex(root).startswith("^"):
                assert [m[n] is not None for n, _ in compiled.flags] == list(r.flags)
        assert parse(to_regex(root)) is None or to_regex(parse(to_regex(root))) == to_regex(root)
