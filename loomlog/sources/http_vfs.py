"""Files behind an HTTP folder API (`<endpoint>/api/vfs/<dir>/`) as a Python data source: listings, and byte ranges."""

from __future__ import annotations

import http.client
import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ATTEMPTS, BACKOFF_S, STALL_S = 3, (0.5, 1.0, 2.0), 60
#: Bytes of a file that are held at once, and that a row has.
PART_BYTES = 16 << 20


class AccessDenied(RuntimeError):
    pass


def _open(url: str, token: str | None, start: int = 0):
    headers = {"Authorization": f"Bearer {token}"} if token else {}
    if start:
        headers["Range"] = f"bytes={start}-"
    return urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=STALL_S)


def list_folder(endpoint: str, folder: str, token: str | None = None) -> list[dict]:
    try:
        with _open(f"{endpoint.rstrip('/')}/api/vfs/{folder.strip('/')}/", token) as r:
            return json.load(r)
    except urllib.error.HTTPError as e:
        if e.code in (401, 403):
            raise AccessDenied(f"{e.code} from {endpoint}") from None
        raise


def fetch_parts(url: str, token: str | None = None, start: int = 0, pause=time.sleep, part_bytes: int = PART_BYTES) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the content from `start` on, part after part, so that a task holds one at a time. Parts end at line
    ends, but for a line of several parts' length. What has arrived survives a broken connection; a server without ranges
    sends everything: offset then begins at 0, or what parts have given already is skipped. Nothing beyond the end is one empty
    part and no error. Server errors are tried again."""
    place, held, begun, failure = start, bytearray(), False, None  # held: bytes from `place` on
    for attempt in range(ATTEMPTS):
        at = place + len(held)
        try:
            with _open(url, token, at) as r:
                skip = 0
                if at and r.status == 200 and begun:
                    skip = at
                elif at and r.status == 200:
                    place, held = 0, bytearray()
                while piece := r.read(1 << 20):
                    held += piece[skip:]
                    skip = max(0, skip - len(piece))
                    if len(held) >= part_bytes:
                        cut = held.rfind(b"\n") + 1 or (len(held) if len(held) >= 4 * part_bytes else 0)
                        if cut:
                            yield place, bytes(held[:cut])
                            place, begun = place + cut, True
                            del held[:cut]
                if r.headers.get("Content-Length") is None or r.length in (0, None):
                    break
                failure = "connection closed early"
        except urllib.error.HTTPError as e:
            if e.code == 416:
                break
            if e.code in (401, 403):
                raise AccessDenied(f"{e.code} from {url}") from None
            if e.code < 500:
                raise
            failure = e
        except (OSError, http.client.HTTPException) as e:
            failure = e
        if attempt + 1 < ATTEMPTS:
            pause(BACKOFF_S[attempt])
    else:
        raise RuntimeError(f"download failed after {ATTEMPTS} attempts: {failure}")
    if held or not begun:
        yield place, bytes(held)


def fetch(url: str, token: str | None = None, start: int = 0, pause=time.sleep) -> tuple[int, bytes]:
    """(offset, bytes): all of it at once; see fetch_parts."""
    (whole,) = fetch_parts(url, token, start, pause, part_bytes=1 << 62)
    return whole


class FilePartition(InputPartition):
    def __init__(self, name: str, url: str, start: int):
        self.name, self.url, self.start = name, url, start


class HttpReader(DataSourceReader):
    def __init__(self, options):
        self.endpoint, self.folder, self.token = options["endpoint"], options.get("folder", ""), options.get("token")
        self.offsets = json.loads(options.get("offsets", "{}"))

    def partitions(self):
        entries = list_folder(self.endpoint, self.folder, self.token)
        base = f"{self.endpoint.rstrip('/')}/api/vfs/{self.folder.strip('/')}/"
        return [FilePartition(e["name"], base + e["name"], int(self.offsets.get(e["name"], 0))) for e in entries if e.get("mime") != "inode/directory"]

    def read(self, partition) -> Iterator[tuple]:
        for offset, data in fetch_parts(partition.url, self.token, partition.start):
            yield partition.name, offset, data


class HttpVfsSource(DataSource):
    """spark.dataSource.register(HttpVfsSource); spark.read.format("http_vfs").option("endpoint", ...).option("folder", ...)
    One task per file, a row for each part of it. Option `offsets`, JSON of name to byte, asks for what lies beyond. `token` is a bearer token."""

    @classmethod
    def name(cls) -> str:
        return "http_vfs"

    def schema(self) -> str:
        return "name string, offset long, content binary"

    def reader(self, schema):
        return HttpReader(self.options)
