"""Token ids as shards that stay searchable: a wavelet matrix per shard, rank and select on its bit-planes.

Plane k of a shard holds bit k (from the highest) of every id, in the order that sorting stably by the bits before it
gives. From the planes alone follow any id (access), how often an id occurs before a place (rank) and where its k-th
occurrence is (select), so counting and looking up need neither the ids nor an index. A shard is one row of one Parquet
file, zstd inside: which ids it holds, its planes, and its documents with their lengths.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .token_counts import byte_alphabet
from .vocabulary import runs_of_rows

BLOCK = 64  # bytes of a plane between two entries of its rank directory


class BitPlane:
    """n bits, packed, with the number of ones before every block of 64 bytes."""

    def __init__(self, packed: bytes, n: int):
        self.n = n
        size = -(-n // (8 * BLOCK)) * BLOCK + BLOCK  # whole blocks, and one of zeros so that place n can be asked for
        self.bytes = np.zeros(size, dtype=np.uint8)
        self.bytes[: len(packed)] = np.frombuffer(packed, dtype=np.uint8)
        ones = np.bitwise_count(self.bytes.reshape(-1, BLOCK)).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])
        self.zeros_before = np.arange(len(self.before)) * 8 * BLOCK - self.before

    def bits(self, at: np.ndarray) -> np.ndarray:
        return (self.bytes[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        out = np.empty(len(at), dtype=np.int64)
        for a in range(0, len(at), 4096):
            part = at[a : a + 4096]
            block, inside = part // (8 * BLOCK), part % (8 * BLOCK)
            held = self.bytes.reshape(-1, BLOCK)[block]
            whole = np.bitwise_count(held) * (np.arange(BLOCK) < (inside >> 3)[:, None])
            last = held[np.arange(len(part)), inside >> 3] >> (8 - (inside & 7)).astype(np.uint8)
            out[a : a + 4096] = self.before[block] + whole.sum(axis=1) + np.bitwise_count(np.where(inside & 7, last, 0).astype(np.uint8))
        return out

    def select(self, bit: int, k: np.ndarray) -> np.ndarray:
        """Places of the k-th ones (or zeros), counted from 0."""
        before = self.before if bit else self.zeros_before
        out = np.empty(len(k), dtype=np.int64)
        for a in range(0, len(k), 4096):
            part = k[a : a + 4096]
            block = np.searchsorted(before, part, side="right") - 1
            held = np.unpackbits(self.bytes.reshape(-1, BLOCK)[block], axis=1) == bit
            nth = np.cumsum(held, axis=1, dtype=np.int16)
            out[a : a + 4096] = block * 8 * BLOCK + (nth <= (part - before[block])[:, None]).sum(axis=1)
        return out


class WaveletMatrix:
    def __init__(self, n: int, planes: Sequence[bytes], zeros: Sequence[int]):
        self.n, self.packed, self.zeros = n, list(planes), list(zeros)
        self._planes: list[BitPlane | None] = [None] * len(self.packed)

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        """ids: unsigned 16 or 32 bit. As many planes as the largest id has bits."""
        n, planes, zeros = len(ids), [], []
        for k in reversed(range(max(1, int(ids.max(initial=0)).bit_length()))):
            ones = ((ids >> ids.dtype.type(k)) & ids.dtype.type(1)).astype(bool)
            planes.append(np.packbits(ones).tobytes())
            zeros.append(n - int(np.count_nonzero(ones)))
            ids = np.concatenate([np.compress(~ones, ids), np.compress(ones, ids)])
        return cls(n, planes, zeros)

    def plane(self, level: int) -> BitPlane:
        if self._planes[level] is None:
            self._planes[level] = BitPlane(self.packed[level], self.n)
        return self._planes[level]

    def ids(self) -> np.ndarray:
        """All ids, from the lowest plane up: what a plane has parted is put together again."""
        kind = np.uint16 if len(self.packed) <= 16 else np.uint32
        ids = np.zeros(self.n, dtype=kind)
        for k, (packed, z) in enumerate(zip(reversed(self.packed), reversed(self.zeros))):
            ones = np.unpackbits(np.frombuffer(packed, dtype=np.uint8), count=self.n).view(bool)
            merged = np.empty(self.n, dtype=kind)
            merged[np.flatnonzero(~ones)] = ids[:z]
            merged[np.flatnonzero(ones)] = ids[z:] | kind(1 << k)
            ids = merged
        return ids

    def access(self, places: np.ndarray) -> np.ndarray:
        """The ids at some places."""
        at, out = np.asarray(places, dtype=np.int64), np.zeros(len(places), dtype=np.int64)
        for level, z in enumerate(self.zeros):
            plane = self.plane(level)
            one, rank = plane.bits(at).astype(bool), plane.rank(at)
            at = np.where(one, z + rank, at - rank)
            out = out << 1 | one
        return out

    def _stretch(self, token: int, start: int, end: int) -> np.ndarray:
        """Where the token's occurrences between start and end lie in the order below the last plane: [first, last)."""
        ends = np.array([start, end], dtype=np.int64)
        for level, z in enumerate(self.zeros):
            rank = self.plane(level).rank(ends)
            ends = z + rank if token >> (len(self.zeros) - 1 - level) & 1 else ends - rank
        return ends

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often the token occurs from start to before end."""
        if token < 0 or token >> len(self.zeros):
            return 0
        first, last = self._stretch(token, start, self.n if end is None else end)
        return int(last - first)

    def places(self, token: int) -> np.ndarray:
        """Where the token occurs, in ascending order."""
        if token < 0 or token >> len(self.zeros):
            return np.zeros(0, dtype=np.int64)
        at = np.arange(*self._stretch(token, 0, self.n), dtype=np.int64)
        for level in reversed(range(len(self.zeros))):
            one = token >> (len(self.zeros) - 1 - level) & 1
            at = self.plane(level).select(one, at - self.zeros[level] if one else at)
        return at


class Encoder:
    """ids of a text as tokenizers gives them for a .json file, without special tokens being added.

    Where a byte-level vocabulary numbers its merges in the order of their ranks (checked here), merging by rank and merging
    by id are the same, and tiktoken's encoder, several times as fast, gives the ids; other files go to tokenizers itself."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        self.vocab = max(spec["model"]["vocab"].values(), default=0)
        self.vocab = max([self.vocab, *(t["id"] for t in spec["added_tokens"])])
        self.kind = np.uint16 if self.vocab < 1 << 16 else np.uint32
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = self._ranks(spec)
        if ranks is None:
            from tokenizers import Tokenizer

            encode = Tokenizer.from_file(path).encode_batch_fast
            self.encode = lambda text: np.array(encode([text], add_special_tokens=False)[0].ids, dtype=self.kind)
        else:
            import tiktoken

            pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
            core = tiktoken.Encoding("by-rank", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)
            everything = set(self.special)
            self.encode = lambda text: np.array(core.encode(text, allowed_special=everything), dtype=self.kind)

    @staticmethod
    def _ranks(spec: dict) -> dict[bytes, int] | None:
        model, level = spec["model"], spec["pre_tokenizer"] or {}
        plain = spec["normalizer"] is None and level.get("type") == "ByteLevel" and level.get("use_regex") and not level.get("add_prefix_space")
        plain = plain and model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        # Special tokens that stand by themselves: neither bound to words nor taking white space along.
        plain = plain and all(t["special"] and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec["added_tokens"])
        if not plain:
            return None
        byte = {c: b for b, c in enumerate(byte_alphabet())}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ordered = [model["vocab"].get(a + b) for a, b in merges]
        if None in ordered or any(x >= y for x, y in zip(ordered, ordered[1:])):
            return None
        made = {a + b for a, b in merges}
        special = {t["content"] for t in spec["added_tokens"]}
        if any(len(t) > 1 and t not in made for t in model["vocab"] if t not in special):
            return None
        return {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _schema(kind: str) -> str:
    return f"range int, first long, n_tokens long, zeros array<long>, planes array<binary>, docs array<struct<doc_id:{kind},n:long>>"


def write_shards(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, shard_tokens: int = 1 << 22, text: str = "text", key: str = "doc_id") -> None:
    """Encode each whole text, end it with end_id, and write the ids in ascending order of key as shards under path.

    A shard holds whole documents up to shard_tokens ids, or one longer document. Null and empty texts have the end id only;
    a null key comes first; rows of one key go by a hash of their text, and equal rows stay apart. Rows are dealt over tasks
    by ranges of (key, hash, row), so a key that many rows have is shared by several; a task holds one shard at a time. An
    empty table gives a folder without shards; other columns are ignored. `tokenizer` is a path that holds on every
    executor."""
    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    order = [F.col("doc_id").asc_nulls_first(), F.col("__hash"), F.col("__row")]
    rows = rows.withColumn("__hash", F.xxhash64("text")).withColumn("__row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    schema = _schema(kind)

    def run(batches):
        encode, names, sizes, held, n, first = encoder(tokenizer), [], [], [], 0, 0
        at, end = TaskContext.get().partitionId(), np.array([end_id], dtype=encoder(tokenizer).kind)
        for batch in batches:
            id_type = batch.column(0).type
            for part in runs_of_rows(batch, 1):
                for name, content in zip(part.column(0), part.column(1).to_pylist()):
                    ids = np.append(encode.encode(content), end) if content else end
                    if held and n + len(ids) > shard_tokens:
                        yield shard(at, first, names, sizes, held, id_type)
                        names, sizes, held, n, first = [], [], [], 0, first + n
                    names.append(name.as_py())
                    sizes.append(len(ids))
                    held.append(ids)
                    n += len(ids)
        if held:
            yield shard(at, first, names, sizes, held, id_type)

    def shard(at, first, names, sizes, held, id_type):
        matrix = WaveletMatrix.build(np.concatenate(held))
        described = pa.StructArray.from_arrays([pa.array(names, id_type), pa.array(sizes, pa.int64())], ["doc_id", "n"])
        columns = [pa.array([at], pa.int32()), pa.array([first], pa.int64()), pa.array([matrix.n], pa.int64()), pa.array([matrix.zeros], pa.list_(pa.int64())), pa.array([matrix.packed], pa.list_(pa.binary()))]
        columns.append(pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), described))
        return pa.RecordBatch.from_arrays(columns, ["range", "first", "n_tokens", "zeros", "planes", "docs"])

    rows.mapInArrow(run, schema).write.option("compression", "zstd").option("maxRecordsPerFile", 1).parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """One row per shard: range (of its ids among all), first (its place in the range), n_tokens, zeros, planes, docs."""
    return spark.read.parquet(path)


def _per_shard(shards: DataFrame, found, schema: str) -> DataFrame:
    """found(matrix, shard) -> columns, one task row per shard; shards are opened one at a time."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                shard = {name: batch.column(name)[k] for name in batch.schema.names}
                matrix = WaveletMatrix(shard["n_tokens"].as_py(), [p.as_buffer() for p in shard["planes"]], shard["zeros"].as_py())
                yield found(matrix, shard)

    return shards.mapInArrow(run, schema)


def read_documents(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit
    integers) and, with content, ids, of every document in the shards."""
    shards = read_shards(spark, path)
    kind = shards.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()

    def found(matrix, shard):
        ids, docs = matrix.ids().astype("<u4"), shard["docs"].values
        sizes = docs.field("n").to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        view = memoryview(ids).cast("B")
        crc = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
        columns = {"doc_id": docs.field("doc_id"), "range": pa.repeat(shard["range"], len(docs)), "first": pa.array(ends - sizes + shard["first"].as_py()), "n_tokens": pa.array(sizes), "ids_crc32": pa.array(crc, pa.int64())}
        if content:
            columns["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32)))
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    more = ", ids array<int>" if content else ""
    docs = _per_shard(shards, found, f"doc_id {kind}, range int, first long, n_tokens long, ids_crc32 long{more}")
    # A range was written by one task, so there are no more rows here than tasks, of which the driver keeps track anyway.
    ranges = shards.groupBy("range").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("range", before.alias("__before"))
    return docs.join(F.broadcast(ranges), "range").select("doc_id", (F.col("__before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if content else []))


def count_ids(spark: SparkSession, path: str, ids: Sequence[int]) -> DataFrame:
    """token, n: how often each of some ids occurs in all shards, by rank only."""

    def found(matrix, shard):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array([matrix.count(t) for t in ids], pa.int64())], ["token", "n"])

    shards = read_shards(spark, path).select("n_tokens", "zeros", "planes")
    return _per_shard(shards, found, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))


def find_id(spark: SparkSession, path: str, token: int) -> DataFrame:
    """doc_id, place: every occurrence of an id, by select, as its document and its place (from 0) there."""
    shards = read_shards(spark, path)
    kind = shards.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()

    def found(matrix, shard):
        docs = shard["docs"].values
        ends = np.cumsum(docs.field("n").to_numpy(zero_copy_only=False))
        places = matrix.places(token)
        at = np.searchsorted(ends, places, side="right")
        return pa.RecordBatch.from_arrays([docs.field("doc_id").take(pa.array(at)), pa.array(places - np.concatenate([[0], ends])[at])], ["doc_id", "place"])

    return _per_shard(shards, found, f"doc_id {kind}, place long")


def ids_at(spark: SparkSession, path: str, doc_ids: Sequence, start: int, end: int) -> DataFrame:
    """doc_id, ids: the ids from place start to before end of a few documents, by access; other planes' bits stay packed."""
    shards = read_shards(spark, path)
    kind = shards.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()
    shards = shards.where(F.exists("docs", lambda d: d["doc_id"].isin(*doc_ids)))
    wanted = set(doc_ids)

    def found(matrix, shard):
        docs = shard["docs"].values
        sizes = docs.field("n").to_numpy(zero_copy_only=False)
        starts = np.cumsum(sizes) - sizes
        rows = [(d, matrix.access(np.arange(s + min(start, n), s + min(end, n))).tolist()) for d, s, n in zip(docs.field("doc_id").to_pylist(), starts.tolist(), sizes.tolist()) if d in wanted]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], docs.field("doc_id").type), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _per_shard(shards, found, f"doc_id {kind}, ids array<int>")
