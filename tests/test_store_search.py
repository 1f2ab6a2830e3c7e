"""Searches over what ingestion has stored: folders that are read, stages that are run, what is left of a stopped search."""

import datetime as dt
import glob
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from helpers import entries_of
from loomlog.operators import result as results
from loomlog.operators.chart import ChartRequest
from loomlog.operators.result import Result, search
from loomlog.operators.search import Request, capped, hits_of, nth_least
from loomlog.sources import catalog
from loomlog.sources.store import cancel, cancellable

DAY = dt.date(2026, 7, 14)


def files_of(spark, n, services=("007", "s2"), days=4):
    rows = [(k, services[k % len(services)], f"f{k:04}", DAY + dt.timedelta(days=k // len(services) % days) if k % 11 else None, k, dt.datetime(2026, 7, 14, 8), dt.datetime(2026, 7, 14, 9)) for k in range(1, n + 1)]
    return spark.createDataFrame(rows, "file_id long, service_id string, file string, log_date date, file_ord long, first_ts timestamp_ntz, last_ts timestamp_ntz")


def stored(spark, tmp_path, n, text=lambda k: f"head of {k}\n14.07.2026 08:00:00 one {k}\n more\n14.07.2026 09:00:00 two {k}\n"):
    files = files_of(spark, n)
    files.write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    entries = entries_of(spark, {k: text(k) for k in range(1, n + 1)}).join(files.select("file_id", "service_id", "log_date"), "file_id")
    path = str(tmp_path / "store")
    catalog.ingest(entries.repartition(1), path)
    return catalog.stored_entries(spark, path), files, path


def spoil(path, keep):
    """Everything in the store's folders that keep(folder) does not hold becomes unreadable."""
    for name in glob.glob(f"{path}/*/*/*.parquet"):
        if not keep(name):
            size = os.path.getsize(name)
            with open(name, "wb") as f:
                f.write(b"x" * size)
            os.path.exists(crc := os.path.join(os.path.dirname(name), f".{os.path.basename(name)}.crc")) and os.unlink(crc)


def test_search_page_export_of_stored_files(spark, tmp_path):
    entries, files, _ = stored(spark, tmp_path, 12)
    assert dict(entries.dtypes)["service_id"] == "string" and {r[0] for r in entries.select("service_id").distinct().collect()} == {"007", "s2"}
    result = search(entries, files, Request("one"))
    assert sorted((r.file_id, r.line_no, r.service_id) for r in result.hits.collect()) == [(k, 2, "007" if k % 2 == 0 else "s2") for k in range(1, 13)]
    page = result.page(0, 3, context=1).collect()
    assert [r.text for r in page] == [f"14.07.2026 08:00:00 one {k}\n more" for k in (12, 11, 10)] and page[0].context_before == ["head of 12"] and page[0].context_after == ["14.07.2026 09:00:00 two 12"]
    assert [r.line for r in result.export().collect()] == [f"14.07.2026 08:00:00 one {k}\n more" for k in range(12, 0, -1)]
    assert result.narrow("two 7", after=1).hits.count() == 1 and result.narrow("head").hits.count() == 0
    chart = result.chart(ChartRequest(mode="category", source="regex", value_pattern="one (?<v>[0-9]+)", metric="sum")) if "source" in ChartRequest.__dataclass_fields__ else None
    assert chart is None or chart.data.count() > 0
    heads = search(entries, files, Request("head of", service_ids=("007",)))
    assert sorted((r.file_id, r.line_no) for r in heads.hits.collect()) == [(k, 1) for k in range(2, 13, 2)]


def test_only_the_requests_folders_are_read(spark, tmp_path):
    entries, files, path = stored(spark, tmp_path, 40)
    request = Request("one", service_ids=("007",), date_from=DAY, date_to=DAY + dt.timedelta(days=1))
    chosen = lambda x: "service_id=007" in x and any(d in x for d in ("2026-07-14", "2026-07-15", "HIVE_DEFAULT"))
    want = search(entries, files, request).hits.select("file_id", "line_no").orderBy("file_id").collect()
    assert want
    spoil(path, chosen)
    assert search(entries, files, request).hits.select("file_id", "line_no").orderBy("file_id").collect() == want
    plan = hits_of(entries, files, request)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("\n") if "PartitionFilters" in x and "entry_line" in x]
    assert scans and all("service_id" in x and "log_date" in x.split("PartitionFilters")[1].split("PushedFilters")[0] for x in scans)
    # A day within the range of which no file is asked for: the join with the files keeps its folder from being read.
    fewer = files.where(F.col("log_date") == F.lit(DAY))
    spoil(path, lambda x: "service_id=007" in x and "2026-07-14" in x)
    assert search(entries, fewer, request).hits.count() == sum(1 for r in want if r.file_id in {f.file_id for f in fewer.collect()})
    # An hour: the days around it, whatever a service's clock.
    hour = Request("one", service_ids=("007",), time_from=dt.datetime(2026, 7, 14, 7), time_to=dt.datetime(2026, 7, 14, 8))
    assert search(entries, fewer, hour).hits.count() > 0


def test_no_stage_begins_after_the_cap(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(results, "cap_of", lambda n: n)
    entries, files, path = stored(spark, tmp_path, 200, lambda k: "".join(f"14.07.2026 08:00:{i:02} one\n" for i in range(10)))
    seen = []
    result = search(entries, files, Request("one"), max_hits=25, progress=seen.append)
    assert [(r.file_id, r.line_no) for r in result.hits.orderBy("file_ord", "line_no").collect()] == [(k, i) for k in (1, 2, 3) for i in range(1, 11)][:25]
    assert len(seen) == 1 and seen[0]["files"] <= 4 and seen[0]["lines"] == 10 * seen[0]["files"] and seen[0]["stages"] == 4
    assert result.totals(None) == {"files_scanned": seen[0]["files"], "lines_scanned": seen[0]["lines"], "total_hits": 25, "truncated": True} and result.complete
    whole = search(entries, files, Request("one"), max_hits=5000)
    assert whole.hits.count() == 2000 and whole.totals(None) == {"files_scanned": 200, "lines_scanned": 2000, "total_hits": 2000, "truncated": False}
    assert search(entries, files, Request("nowhere"), max_hits=100).totals(None) == {"files_scanned": 200, "lines_scanned": 2000, "total_hits": 0, "truncated": False}
    lazy = search(entries, files, Request("one"), max_hits=None if False else 0)
    assert sorted(map(tuple, whole.hits.select(*lazy.hits.columns).collect())) == sorted(map(tuple, Result(hits_of(entries, files, Request("one")), *[getattr(lazy, n) for n in ("entries", "files", "fields", "group_names", "order")]).hits.collect()))


def test_a_stopped_search_keeps_what_is_through(spark, tmp_path):
    entries, files, _ = stored(spark, tmp_path, 200)
    every = {r.file_id for r in search(entries, files, Request("one")).hits.collect()}
    seen = []
    result = search(entries, files, Request("one"), progress=seen.append, stop=lambda: len(seen) == 2)
    assert not result.complete and len(seen) == 2
    got = {r.file_id for r in result.hits.collect()}
    assert got == set(range(1, seen[1]["files"] + 1)) and got < every and result.totals(None)["files_scanned"] == len(got)
    # Cancelled from outside while its second stage is to run.
    began = threading.Event()

    def progress(x):
        began.set()
        threading.Event().wait(0.1)

    def canceller():
        began.wait(60)
        for _ in range(200):
            cancel(spark, "this-search")
            if done.wait(0.05):
                return

    done = threading.Event()
    t = threading.Thread(target=canceller)
    t.start()
    try:
        with cancellable(spark, "this-search"):
            result = search(entries, files, Request("one"), progress=progress)
    finally:
        done.set()
        t.join()
    assert not result.complete and {r.file_id for r in result.hits.collect()} < every
    assert search(entries, files, Request("one"), stop=lambda: True).hits.count() == 0


@pytest.mark.parametrize("size", [1, 2, 500])
def test_the_cut_is_exact(spark, size):
    rng = random.Random(size)
    rows = list({(rng.choice([-5, 3, 3, 3, 1 << 60, rng.randint(0, 50)]), rng.randint(1, 40)) for _ in range(size)})
    hits = spark.createDataFrame(rows, "file_ord long, line_no long").repartition(3)
    for cap in {1, len(rows) // 2 or 1, len(rows) - 1 or 1, len(rows), len(rows) + 1}:
        assert sorted(map(tuple, capped(hits, cap).collect())) == sorted(rows)[:cap]
    values = sorted(r[0] for r in rows)
    for n in {1, len(rows) // 3 or 1, len(rows)}:
        assert nth_least(hits, "file_ord", n, some=3) == (values[n - 1], values.index(values[n - 1]))
