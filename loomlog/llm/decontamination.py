"""Benchmark passages in documents, exact or with a few edits, by the q-gram lemma on diagonal bands.

An item of m characters that occurs with at most k edits keeps at least m - q + 1 - kq of its q-grams, and their diagonals
(place in the document less place in the item) lie within k of each other. So hits are counted in bands of 2(k + 1)
diagonals that begin every k + 1 and so overlap by half: one of them holds all the kept q-grams. Bands that reach the
bound are verified by banded alignment. Documents and items are compared in lower case, each run of white space as one
space. Hits of a batch of documents come from array arithmetic on rolling hashes.

Where both an item and a document repeat themselves, each place of the one hits many of the other, and pairs of places are
not listed. There each place counts once for an item: where as many places as the lemma asks for lie no further apart
than an occurrence can reach, the diagonals of all of them are one wide band.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import materialize
from .vocabulary import runs_of_rows

_WORD = re.compile(r"\S+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22
MOST_PAIRS = 1 << 19  # pairs of places that are listed at once


def normalise(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def rolling(x: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q characters from each place on, by doubling: h(a + b) = h(a) * BASE^b + h(b)."""
    if len(x) < q:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        have, size, step, width, base = None, 0, x, 1, _BASE
        rest = q
        while rest:
            if rest & 1:
                if have is None:
                    have, size = step, width
                else:  # have covers `size` characters; step continues it
                    n = len(x) - (size + width) + 1
                    have, size = have[:n] * base + step[size : size + n], size + width
            rest >>= 1
            if rest:
                n = len(step) - width
                step, width, base = step[:n] * base + step[width : width + n], 2 * width, base * base
    return have


def banded_distance(item: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> tuple[int, int, int]:
    """Least edits (if at most k) between the item and a stretch of text, and that stretch; (k + 1, 0, 0) if more.

    Only alignments on the diagonals low to high count (place in the text less place in the item), so time is item length
    times high - low and memory high - low. An alignment of at most k edits changes its diagonal at most k times."""
    m, n = len(item), len(text)
    diagonals = np.arange(low, high + 1)
    far = k + 1
    cost = np.where((diagonals >= 0) & (diagonals <= n), 0, far)
    origin = np.clip(diagonals, 0, n)
    padded = np.full(m + len(diagonals) + 1, -1, dtype=np.int64)  # text[low], text[low + 1], ... with -1 outside of the text
    first, last = max(0, low), min(n, low + len(padded))
    if last > first:
        padded[first - low : last - low] = text[first:last]
    steps = np.arange(len(diagonals))
    for i in range(1, m + 1):
        fresh = padded[i - 1 : i - 1 + len(diagonals)]
        straight = cost + (fresh != item[i - 1])
        skipped = np.append(cost[1:], far) + 1  # the item's character is missing from the text
        best = np.minimum(straight, skipped)
        source = np.where(straight <= skipped, origin, np.append(origin[1:], 0))
        ends = diagonals + i
        best[(ends < 0) | (ends > n)] = far
        # Characters that the text has more: the smallest of best[d] + (place - d) over diagonals d to the left.
        shifted = best - steps
        least = np.minimum.accumulate(shifted)
        at = np.maximum.accumulate(np.where(shifted == least, steps, 0))
        cost, origin = np.minimum(least + steps, far), source[at]
        cost[(ends < 0) | (ends > n)] = far
        if cost.min() > k:
            return k + 1, 0, 0
    d = int(cost.argmin())
    return int(cost[d]), int(origin[d]), m + low + d


class GramTable:
    """The q-grams of the items of one q: their hashes in order, and for each its items and places."""

    def __init__(self, texts: list[str], items: list[int], q: int):
        self.q = q
        each = [rolling(codes(texts[i]), q) for i in items]
        sizes = [len(h) for h in each]
        h = np.concatenate(each)
        order = np.argsort(h, kind="stable")
        self.hashes, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.items = np.repeat(np.array(items, dtype=np.int64), sizes)[order]
        self.places = np.concatenate([np.arange(n, dtype=np.int64) for n in sizes])[order]
        # Each item's distinct grams, by their number in hashes: those of items[k] from bounds[k] on.
        gram = np.repeat(np.arange(len(self.hashes)), self.count)
        both = np.unique(np.stack([self.items, gram], axis=1), axis=0)
        self.own, self.bounds = np.unique(both[:, 0], return_index=True)
        self.bounds, self.own_grams = np.append(self.bounds, len(both)), both[:, 1]
        self.filter = np.zeros(1 << _BITS, dtype=bool)
        self.filter[(self.hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def matched(self, big: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of big whose q-gram an item has, and the number of that gram."""
        h = rolling(big, self.q)
        place = np.flatnonzero(self.filter[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, h[place]), len(self.hashes) - 1)
        real = self.hashes[at] == h[place]
        return place[real], at[real]

    def pairs(self, place: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, item and place in the item of every occurrence of those grams in an item."""
        count = self.count[at]
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        entry = np.repeat(self.first[at], count) + within
        return np.repeat(place, count), self.items[entry], self.places[entry]

    def items_of(self, at: np.ndarray, need: np.ndarray):
        """The items of which at least need[item] of some grams are, each with whether a gram is one of its own."""
        often = np.bincount(at, minlength=len(self.hashes))
        for k in np.flatnonzero(np.add.reduceat(often[self.own_grams], self.bounds[:-1]) >= need[self.own]):
            held = np.zeros(len(self.hashes), dtype=bool)
            held[self.own_grams[self.bounds[k] : self.bounds[k + 1]]] = True
            yield int(self.own[k]), held[at]


@dataclass
class BenchmarkIndex:
    """Items of m characters are found with up to k = max_error * m edits. Each has the largest q up to `q` for which the
    lemma leaves at least one q-gram, m // (k + 1). Items under `q` characters without edits count as whole words only."""

    ids: list
    texts: list[str]
    q: int = 12
    max_error: float = 0.05

    def __post_init__(self):
        self.texts = list(self.texts)
        sizes = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.budget = np.floor(self.max_error * sizes + 1e-9).astype(np.int64)
        grams = np.minimum(self.q, sizes // (self.budget + 1))
        self.need = sizes - grams + 1 - self.budget * grams
        self.whole_words = (sizes < self.q) & (self.budget == 0)
        self.tables = [GramTable(self.texts, np.flatnonzero(grams == g).tolist(), int(g)) for g in np.unique(grams) if g > 0]

    def hits(self, texts: list[str], every: bool = True) -> dict[int, list[tuple[int, int, int, int]]]:
        """Document -> (item, edits, start, end) in its normalised text; unless every, where text and item repeat themselves
        only the first."""
        big = codes(("\0" * self.q).join(texts))  # no q-gram of an item crosses from one document to the next
        starts = np.concatenate([[0], np.cumsum([len(t) + self.q for t in texts])[:-1]]).astype(np.int64)
        found: dict[int, list] = {}
        for table in self.tables:
            place, at = table.matched(big)
            doc = np.searchsorted(starts, place, side="right") - 1
            pairs = np.bincount(doc, weights=table.count[at], minlength=len(texts)).astype(np.int64)
            repeats = pairs > 2 * np.array([len(t) for t in texts]) + 1000
            # The others, so many documents at a time that their pairs are about MOST_PAIRS.
            part = np.cumsum(np.where(repeats, 0, pairs)) // MOST_PAIRS
            for p in np.unique(part[pairs > 0]):
                some = (part[doc] == p) & ~repeats[doc]
                self._in_bands(table, texts, starts, place[some], at[some], found)
            for d in np.flatnonzero(repeats):
                own = slice(*np.searchsorted(doc, [d, d + 1]))
                for i, held in table.items_of(at[own], self.need):
                    self._in_wide_bands(texts[d], i, table.q, (place[own] - starts[d])[held], found.setdefault(int(d), []), every)
                    if found[int(d)] and not every:
                        break
        return {d: x for d, x in found.items() if x}

    def _in_bands(self, table: GramTable, texts: list[str], starts: np.ndarray, place: np.ndarray, at: np.ndarray, found: dict) -> None:
        if not len(place):
            return
        place, item, spot = table.pairs(place, at)
        doc = np.searchsorted(starts, place, side="right") - 1
        diagonal = place - starts[doc] - spot
        band = diagonal // (self.budget[item] + 1)
        key = np.stack([np.tile(doc, 2), np.tile(item, 2), np.concatenate([band, band - 1]), np.tile(spot, 2)], axis=1)
        key = np.unique(key, axis=0)  # each q-gram of the item counts once in a band
        groups, sizes = np.unique(key[:, :3], axis=0, return_counts=True)
        for d, i, b in groups[sizes >= self.need[groups[:, 1]]].tolist():
            self._verify(texts[d], i, b, found.setdefault(d, []))

    def _in_wide_bands(self, text: str, i: int, q: int, places: np.ndarray, hits: list, every: bool) -> None:
        """Add to hits the occurrences of item i, none over another, among places of its grams: from the first place of
        enough of them, the item may have begun as far before as it is long. Like windows are verified once."""
        k, m, need = int(self.budget[i]), len(self.texts[i]), int(self.need[i])
        last = places[need - 1 :]
        begin = places[: len(last)][last - places[: len(last)] <= m - q + k]
        free, n, known = 0, 0, {}
        while n < len(begin):
            at = int(begin[n])
            first = len(hits)
            self._verify_wide(text, i, max(free, at - (m - q)) - k, at + k, hits, known)
            if len(hits) > first:
                if not every:
                    return
                free = max(x[3] for x in hits[first:])
                while self.texts[i] == text[free : free + m] and not self.whole_words[i]:
                    hits.append((i, 0, free, free + m))
                    free += m
                n = int(np.searchsorted(begin, free))
            else:
                n = int(np.searchsorted(begin, at + max(1, m - q)))
                # What begins between the two is within the next window, which reaches back as far.
                n = n if n < len(begin) or at == begin[-1] else len(begin) - 1

    def _verify_wide(self, text: str, i: int, lowest: int, highest: int, hits: list, known: dict) -> None:
        k, item = int(self.budget[i]), self.texts[i]
        if highest < lowest:
            return
        low, high = max(0, lowest), min(len(text), highest + len(item) + 1)
        window = (text[low:high], lowest - low, text[low - 1 : low], text[high : high + 1])
        if window not in known:
            if len(known) >= 16:
                known.clear()
            known[window] = self._best(*window[:2], highest - low, i, *window[2:])
        if known[window] is not None:
            edits, a, e = known[window]
            self._verify_wide(text, i, lowest, low + a - len(item), hits, known)  # one more, before it
            hits.append((i, edits, low + a, low + e))

    def _best(self, text: str, lowest: int, highest: int, i: int, before: str, behind: str) -> tuple[int, int, int] | None:
        """(edits, start, end) of the item in a stretch of text."""
        k, item = int(self.budget[i]), self.texts[i]
        at = text.find(item)
        while at >= 0:
            ends = (text[at - 1 : at] if at else before, text[at + len(item) : at + len(item) + 1] or behind)
            if not (self.whole_words[i] and any(c.isalnum() for c in ends)):
                return 0, at, at + len(item)
            at = text.find(item, at + 1)
        if k:
            edits, a, e = banded_distance(codes(item), codes(text), lowest, highest, k)
            if edits <= k:
                return edits, a, e
        return None

    def _verify(self, text: str, i: int, b: int, hits: list) -> None:
        """Add to hits what the band b of item i holds, if it is within the budget. Bands of an item come in order."""
        k, item = int(self.budget[i]), self.texts[i]
        lowest, highest = b * (k + 1) - k, (b + 2) * (k + 1) - 1 + k  # diagonals of alignments that the band may count for
        low, high = max(0, lowest), min(len(text), highest + len(item) + 1)
        if hits and hits[-1][0] == i and hits[-1][2] >= low and hits[-1][3] <= high:
            return  # the band before gave this hit
        at = text.find(item, low, high)
        if at >= 0:
            ends = (text[at - 1 : at], text[at + len(item) : at + len(item) + 1])
            if not (self.whole_words[i] and any(c.isalnum() for c in ends)):
                hits.append((i, 0, at, at + len(item)))
        elif k:
            edits, a, e = banded_distance(codes(item), codes(text[low:high]), lowest - low, highest - low, k)
            if edits <= k:
                hits.append((i, edits, low + a, low + e))


def original_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Where stretches of the normalised text lie in the text itself (exact but for letters whose lower case has another
    length). The words are walked once, however many stretches there are."""
    places, starts, sizes, at = [], [], [], 0
    for m in _WORD.finditer(text):
        places.append(at)
        starts.append(m.start())
        sizes.append(len(m[0].lower()))
        at += sizes[-1] + 1

    def place(x: int) -> int:
        k = bisect_right(places, x) - 1
        return starts[k] + min(x - places[k], sizes[k])

    return [(place(a), place(b - 1) + 1) for a, b in spans]


def _blocks(benchmark: DataFrame, item: str, item_text: str, block_chars: int) -> tuple[DataFrame, int]:
    items = benchmark.select(benchmark[item].alias("item_id"), F.coalesce(benchmark[item_text], F.lit("")).alias("item_text")).where("trim(item_text) <> ''").distinct()
    return items, max(1, -(-items.agg(F.coalesce(F.sum(F.length("item_text")), F.lit(0))).first()[0] // block_chars))


def _sent(items: DataFrame, blocks: int, b: int):
    """Block b of the items, which holds about block_chars characters, on every executor."""
    block = items.where(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(blocks)) == b).collect()
    return items.sparkSession.sparkContext.broadcast([(r[0], t) for r in block if (t := normalise(r[1]))])


def _per_block(docs: DataFrame, items: DataFrame, blocks: int, run, schema: str | StructType) -> DataFrame:
    """docs after run(batches, index, last) for each block of items in turn. All but the last result are written, so that
    one block's index at a time lives on the executors and in the driver."""
    for b in range(blocks):
        sent, last = _sent(items, blocks, b), b == blocks - 1
        docs = docs.mapInArrow(lambda batches, sent=sent, last=last: run(batches, sent.value, last), schema)
        if not last:
            docs = materialize(docs, "after-block")
            sent.destroy()
    return docs


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text", q: int = 12, max_error: float = 0.05, block_chars: int = 8_000_000) -> DataFrame:
    """One row per document: key, contaminated, leaks (item_id, edits, start, end in code points of the text).

    An item leaks where a stretch of the document is within max_error * length edits of it; items of fewer than q
    characters leak as whole words. Items count as a whole: a document that quotes a part of a long item is clean unless
    the part is an item of its own. Items and documents that are null or blank match nothing; items with a null id are
    looked for too; an item that repeats with its id is one. The benchmark is taken in blocks of about block_chars
    characters, one after another, each with a pass over the documents; no document is shuffled. Texts of any length are
    taken whole; time is proportional to their length and to the hits, and where item and text repeat themselves to the
    product of text length and item length at most; of an item's leaks there, none lies over another. An empty benchmark leaves every document clean;
    rows may repeat; other columns are ignored.
    """
    items, blocks = _blocks(benchmark, item, item_text, block_chars)
    span = "array<struct<item_id:" + items.schema["item_id"].dataType.simpleString() + ",edits:int,start:int,end:int>>"
    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"), F.lit(None).cast(span).alias("leaks"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches, block, last):
        known = BenchmarkIndex([i for i, _ in block], [t for _, t in block], q, max_error)
        for batch in batches:
            for part in runs_of_rows(batch, 1):
                texts, leaks = part.column(1).to_pylist(), part.column(2).to_pylist()
                for d, found in known.hits([normalise(t) for t in texts]).items():
                    found = sorted(found, key=lambda x: x[2:])
                    where = original_spans(texts[d], [x[2:] for x in found])
                    new = [{"item_id": known.ids[i], "edits": e, "start": a, "end": b} for (i, e, _, _), (a, b) in zip(found, where)]
                    leaks[d] = (leaks[d] or []) + new
                kept = pa.nulls(len(texts), pa.string()) if last else part.column(1)
                yield pa.RecordBatch.from_arrays([part.column(0), kept, pa.array(leaks, batch.column(2).type)], ["doc_id", "text", "leaks"])

    rows = _per_block(rows, items, blocks, run, f"doc_id {kind}, text string, leaks {span}")
    leaks = F.coalesce("leaks", F.array().cast(span))
    return rows.select("doc_id", (F.size(leaks) > 0).alias("contaminated"), leaks.alias("leaks"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", q: int = 12, max_error: float = 0.05, block_chars: int = 8_000_000) -> DataFrame:
    """The rows of docs in which no item leaks, with all their columns; for the rest see find_leaks."""
    items, blocks = _blocks(benchmark, item, item_text, block_chars)
    at = docs.columns.index(text)

    def run(batches, block, last):
        known = BenchmarkIndex([i for i, _ in block], [t for _, t in block], q, max_error)
        for batch in batches:
            for part in runs_of_rows(batch, at):
                hit = known.hits([normalise(t) for t in part.column(at).to_pylist()], every=False)
                yield part.filter(pa.array([d not in hit for d in range(part.num_rows)], pa.bool_()))

    return _per_block(docs, items, blocks, run, docs.schema)
