"""What a stream from growing files keeps beside the segments: manifest, state, forgotten and migrated files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomlog.sources import catalog, store
from loomlog.streaming import growing
from loomlog.streaming.growing import follow, forget, migrate, store_batch, stored_segments


@pytest.fixture
def place(spark, tmp_path):
    (tmp_path / "in").mkdir()

    class Place:
        log, other, target = tmp_path / "in" / "Log.txt", tmp_path / "in" / "b.txt", str(tmp_path / "out")

        def run(self):
            assert follow(spark, str(tmp_path / "in" / "*.txt"), self.target, str(tmp_path / "ck"), service_id="svc").awaitTermination(180)

        def lines(self):
            return [(r.path.rsplit("/", 1)[1], str(r.log_date), r.line) for r in stored_segments(spark, self.target).orderBy("path", "batch", "line_no").collect()]

        def manifest(self):
            rows, version = store.load_manifest(spark, f"{self.target}/manifest")
            return {r.key.rsplit("/", 1)[1]: (r.size, r.first_ts, r.last_ts) for r in rows.collect()}, version

    return Place()


DAY1, DAY2 = b"head\n14.07.2026 08:00:00 a\n more\n", b"15.07.2026 00:00:01 b\n"
AT = lambda d, h, s: dt.datetime(2026, 7, d, h, 0, s)


def test_batches_merge_into_the_manifest(spark, place):
    place.log.write_bytes(DAY1 + DAY2)
    place.other.write_bytes(b"no time at all\n")
    place.run()
    first = {"Log.txt#2026-07-14": (33, AT(14, 8, 0), AT(14, 8, 0)), "Log.txt#2026-07-15": (22, AT(15, 0, 1), AT(15, 0, 1)), "b.txt#": (15, None, None)}
    assert place.manifest() == (first, 2)
    with place.log.open("ab") as f:
        f.write(b"15.07.2026 00:00:09 c\n")
    place.run()
    second = {**first, "Log.txt#2026-07-15": (44, AT(15, 0, 1), AT(15, 0, 9))}
    assert place.manifest() == (second, 4)
    lines = place.lines()
    assert [x[2] for x in lines] == ["head", "14.07.2026 08:00:00 a", " more", "15.07.2026 00:00:01 b", "15.07.2026 00:00:09 c", "no time at all"]
    # The second batch once more, as after a failure: nothing changes.
    mtime = place.log.stat().st_mtime
    again = spark.createDataFrame([(str(place.log), len(DAY1 + DAY2), False, False, mtime, bytearray(b"15.07.2026 00:00:09 c\n"))], "path string, start long, fresh boolean, again boolean, mtime double, content binary")
    store_batch(spark, again, 1, place.target, service_id="svc")
    assert place.manifest() == (second, 4) and place.lines() == lines
    rows, _ = store.load_manifest(spark, f"{place.target}/manifest")
    assert catalog.clock_offsets(rows.where("last_ts is not null").withColumn("mtime", F.lit("2026-07-15 00:00:09").cast("timestamp"))).first().offset_minutes == 0
    assert catalog.status(rows).first().files == 3


def test_files_that_rest_are_not_opened_again(tmp_path, monkeypatch):
    looked = []
    ends = growing._whole_lines
    monkeypatch.setattr(growing, "_whole_lines", lambda path, *more: looked.append(path.rsplit("/", 1)[1]) or ends(path, *more))
    one, two = tmp_path / "a.log", tmp_path / "b.log"
    one.write_bytes(b"x\ny\nhalf")
    two.write_bytes(b"z\n")
    reader = growing.GrowingReader({"path": str(tmp_path / "*.log")})
    first = reader.latestOffset()
    assert [f["size"] for f in first["files"].values()] == [4, 2] and reader.latestOffset() == first and looked == ["a.log", "b.log"]
    assert [(p.start, p.end, p.fresh) for p in reader.partitions({"files": {}}, first)] == [(0, 4, True), (0, 2, True)] and not reader.partitions(first, first)
    one.write_bytes(b"x\ny\nhalf a line\n")
    two.write_bytes(b"Z\n")  # as long as before, with other bytes
    second = reader.latestOffset()
    assert looked[2:] == ["a.log", "b.log"] and [(p.start, p.end, p.fresh) for p in reader.partitions(first, second)] == [(4, 16, False), (0, 2, True)]
    two.unlink()
    assert list(reader.latestOffset()["files"]) == [str(one)] and looked[4:] == []


def test_a_file_without_segments_is_new_again(spark, place):
    place.log.write_bytes(DAY1 + DAY2)
    place.run()
    key = lambda day: f"{place.log}#{day}"
    forget(spark, place.target, [key("2026-07-14")])
    assert [x[2] for x in place.lines()] == ["15.07.2026 00:00:01 b"]
    with place.log.open("ab") as f:
        f.write(b"15.07.2026 00:00:02 c\n")
    place.run()
    assert [x[2] for x in place.lines()] == ["15.07.2026 00:00:01 b", "15.07.2026 00:00:02 c"]  # still known: only what is new
    forget(spark, place.target, [key("2026-07-15")])
    assert place.lines() == [] and place.manifest() == ({}, 5)
    place.run()
    whole = ["head", "14.07.2026 08:00:00 a", " more", "15.07.2026 00:00:01 b", "15.07.2026 00:00:02 c"]
    assert [x[2] for x in place.lines()] == whole and place.manifest()[0]["Log.txt#2026-07-15"] == (44, AT(15, 0, 1), AT(15, 0, 2))
    with place.log.open("ab") as f:
        f.write(b"16.07.2026 00:00:00 d\n")
    place.run()
    assert [x[2] for x in place.lines()] == [*whole, "16.07.2026 00:00:00 d"]
    forget(spark, place.target, [key("2026-07-14")])
    forget(spark, place.target, [key("2026-07-15")])
    assert [x[2] for x in place.lines()] == ["16.07.2026 00:00:00 d"]


def test_files_stored_whole_are_migrated(spark, place):
    place.log.write_bytes(DAY1 + DAY2 + b"15.07.2026 00:00:05 new\n")
    old = spark.createDataFrame([(str(place.log), (DAY1 + DAY2).decode(), 5.0)], "path string, value string, mtime double")
    migrate(spark, old, place.target, service_id="svc")
    migrate(spark, old, place.target, service_id="svc")  # interrupted and repeated
    assert [x[1:] for x in place.lines()] == [("2026-07-14", "head"), ("2026-07-14", "14.07.2026 08:00:00 a"), ("2026-07-14", " more"), ("2026-07-15", "15.07.2026 00:00:01 b")]
    place.run()
    assert [x[2] for x in place.lines()][-2:] == ["15.07.2026 00:00:01 b", "15.07.2026 00:00:05 new"] and len(place.lines()) == 5
    assert place.manifest()[0]["Log.txt#2026-07-15"] == (46, AT(15, 0, 1), AT(15, 0, 5))
    with pytest.raises(RuntimeError, match="begun"):
        migrate(spark, old, place.target)
