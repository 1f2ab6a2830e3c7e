"""Files read in parts: byte ranges, runs of zstd frames."""

import datetime as dt
import os
import random

import pytest
import zstandard

from loomlog.operators.lines import read_lines
from loomlog.sources.ranges import fetch_ranges, frames, open_file, zstd_lines

WANTED = "key string, path string, start long, size long"


def framed(data, rng, most, level=3):
    """data as frames cut anywhere, with skippable and empty frames, checksums and sizes now and then."""
    out, at = b"", 0
    while at < len(data):
        n = rng.randint(1, most)
        c = zstandard.ZstdCompressor(level=level, write_checksum=rng.random() < 0.5, write_content_size=rng.random() < 0.5)
        out += c.compress(data[at : at + n])
        at += n
        if rng.random() < 0.2:
            out += (0x184D2A50 + rng.randint(0, 15)).to_bytes(4, "little") + (5).to_bytes(4, "little") + b"hello"
        if rng.random() < 0.2:
            out += c.compress(b"")
    return out


@pytest.mark.parametrize("most, run_bytes, end", [(90, 1, b""), (300, 60, b"\n"), (300, 200, b"\r\n"), (100_000, 1 << 20, b"\n\n")])
def test_frames_are_read_as_the_plain_file(spark, tmp_path, most, run_bytes, end):
    rng = random.Random(most)
    texts = []
    for k in range(3):
        lines = ["".join(rng.choice("ab é\r") for _ in range(rng.choice([0, 3, 20, 400]))) for _ in range(25)]
        texts.append("\n".join(lines).encode() + end)
        (tmp_path / f"{k} x.log").write_bytes(texts[-1])
        (tmp_path / f"{k} x.log.zst").write_bytes(framed(texts[-1], rng, most))
    rows = lambda df: sorted((r.file.removesuffix(".zst"), r.line_no, r.line) for r in df.collect())
    plain = rows(read_lines(spark, [str(tmp_path / "*.log")]))
    packed = read_lines(spark, [str(tmp_path / "*.zst")])
    assert rows(packed) == plain and len(plain) >= 70
    names = [x for x in packed.select("file").distinct().toPandas().file]
    assert rows(zstd_lines(spark, names, run_bytes)) == plain
    assert rows(read_lines(spark, [str(tmp_path / "0 x.log.zst"), str(tmp_path / "1 x.log")])) == [r for r in plain if "/2" not in r[0].replace("%20x", "")[-7:]]


def test_one_file_is_many_tasks(spark, tmp_path):
    data = "".join(f"{k} {random.Random(k).random()}\n" for k in range(20_000)).encode()
    path = tmp_path / "a.zst"
    path.write_bytes(framed(data, random.Random(1), 60_000))
    with open_file(str(path)) as file:
        found = list(frames(file))
    assert len(found) > 10 and found[-1][1] <= path.stat().st_size
    lines = zstd_lines(spark, [f"file://{path}"], 40_000)
    assert lines.rdd.getNumPartitions() > 4 and lines.count() == 20_000
    assert lines.where("line_no = 12345").first().line.startswith("12344 ")


def test_cut_off_and_foreign_files(tmp_path):
    whole = zstandard.compress(os.urandom(1000))
    (tmp_path / "cut").write_bytes(whole[:-20])
    (tmp_path / "foreign").write_bytes(b"plain text")
    for name, error in (("cut", EOFError), ("foreign", ValueError)):
        with open_file(str(tmp_path / name)) as file, pytest.raises(error):
            list(frames(file))


@pytest.mark.parametrize("step", [17, 50, 1 << 20])
def test_ranges_are_whole_lines_in_order(spark, tmp_path, step):
    rng = random.Random(step)
    for k, start in enumerate((0, 5, 111)):
        data = "".join("é" * rng.choice([0, 1, 30]) + "\n" for _ in range(20)).encode() + rng.choice([b"", b"open"])
        (tmp_path / f"f{k}").write_bytes(data)
        rows = fetch_ranges(spark.createDataFrame([("k", str(tmp_path / f"f{k}"), min(start, len(data)), len(data))], WANTED), step).orderBy("start").collect()
        assert b"".join(bytes(r.content) for r in rows) == data[start:] and all(r.error is None for r in rows)
        at = start
        for r in rows:
            assert r.start == at and (bytes(r.content).endswith(b"\n") or r is rows[-1])
            at += len(r.content)


def test_tail_of_a_large_file_and_missing_ones(spark, tmp_path):
    big = tmp_path / "big.log"
    with open(big, "wb") as f:
        f.truncate(3 << 30)  # a hole
        f.seek(3 << 30)
        f.write(b"new line\n")
    (tmp_path / "shrunk").write_bytes(b"abc")
    (tmp_path / "same").write_bytes(b"abc")
    (tmp_path / "empty").write_bytes(b"")
    rows = [("big", f"file:{big}", 3 << 30, (3 << 30) + 9), ("gone", str(tmp_path / "gone"), 0, 9), ("shrunk", str(tmp_path / "shrunk"), 0, 9), ("same", str(tmp_path / "same"), 3, 3), ("empty", str(tmp_path / "empty"), 0, 0)]
    got = {r.key: r for r in fetch_ranges(spark.createDataFrame(rows, WANTED)).collect()}
    assert len(got) == 5 and bytes(got["big"].content) == b"new line\n" and got["big"].start == 3 << 30
    assert got["gone"].error.startswith("FileNotFoundError") and got["gone"].content is None
    assert got["shrunk"].error == "EOFError: has 3 bytes, 9 when it was listed"
    assert bytes(got["same"].content) == b"" == bytes(got["empty"].content)


def test_a_file_that_vanishes_stops_no_other(spark, tmp_path, monkeypatch):
    from test_sync import DATED, TODAY, pack

    from loomlog.plans.packs import Registry
    from loomlog.sources import ranges, store, sync

    monkeypatch.setattr(ranges.fetch_ranges, "__defaults__", (10,))
    logs = tmp_path / "logs"
    logs.mkdir()
    names = [f"log-2026-07-{d:02}.log" for d in (20, 21, 22)]
    for n in names:
        (logs / n).write_text(f"2026-07-20T08:00:00Z first of {n}\n more\n2026-07-20T09:00:00Z last\n")
    registry = Registry.load([pack("core", "local-folder", root=str(tmp_path))])
    fetch = sync.LocalFolder.fetch

    def losing(self, spark, wanted, tokens):
        (logs / names[1]).unlink(missing_ok=True)
        return fetch(self, spark, wanted, tokens)

    monkeypatch.setattr(sync.LocalFolder, "fetch", losing)
    service = {"id": "core_a", "pack_id": "core", "endpoint": str(tmp_path), "location": "core"}
    folder = str(tmp_path / "store")
    row = sync.sync(spark, [service], registry, folder, TODAY).first()
    assert (row.listed, row.fetched, row.failed) == (3, 2, 1) and "FileNotFoundError" in row.message
    manifest, _ = store.load_manifest(spark, f"{folder}/manifest")
    assert sorted((r.file, r.size, r.first_ts, r.last_ts) for r in manifest.collect()) == [(n, (tmp_path / "logs" / n).stat().st_size, dt.datetime(2026, 7, 20, 8), dt.datetime(2026, 7, 20, 9)) for n in (names[0], names[2])]
    texts = {r.key.rsplit("/", 1)[1]: r.value for r in sync.stored_files(spark, folder).collect()}
    assert texts == {n: (logs / n).read_text() for n in (names[0], names[2])}
    assert sync.export_file(spark, folder, f"core_a/{DATED['id']}/{names[2]}").decode() == texts[names[2]]
