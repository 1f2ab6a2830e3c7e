"""Words of many texts as numbers, so that scoring a batch is arithmetic on arrays; batches cut to a bounded size."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = re.compile(r"\s")
MOST = 1 << 20  # bytes or characters of text that are held as words at once


class _Numbers(dict):
    """word -> number, given in order of appearance; `fresh` has the words that got one since it was last emptied."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word):
        at = self[word] = len(self)
        self.fresh.append(word)
        return at


class WordRows:
    """Gives each distinct word a row of a growing table; `score(words)` fills the rows of new words, many at once.

    `split` gives the words of a text. Lives in a Python worker; emptied when it holds `limit` words or 8 million
    characters of them. Words of about `most` characters of text are held at once, however long a text is.
    """

    def __init__(self, score, columns: int, split, limit: int = 1 << 18, most: int = MOST):
        self.score, self.columns, self.split, self.limit, self.most = score, columns, split, limit, most
        self.reset()

    def reset(self):
        self.row, self.characters, self.table = _Numbers(), 0, np.zeros((1024, self.columns))

    def _looked_up(self, parts: list[list[str]]) -> np.ndarray:
        if len(self.row) >= self.limit or self.characters > 8_000_000:
            self.reset()
        get = self.row.__getitem__
        flat = np.fromiter((i for words in parts for i in map(get, words)), dtype=np.int64, count=sum(map(len, parts)))
        fresh = self.row.fresh
        if fresh:
            first = len(self.row) - len(fresh)
            if len(self.row) > len(self.table):
                bigger = np.zeros((max(len(self.row), 2 * len(self.table)), self.columns))
                bigger[:first] = self.table[:first]
                self.table = bigger
            self.table[first : len(self.row)] = self.score(fresh)
            self.characters += sum(map(len, fresh))
            self.row.fresh = []
        return self.table[flat]

    def pieces(self, texts: list):
        """(owners, counts, rows): the rows of the words of a stretch of the texts, dealt to texts in order."""
        owners, parts, held = [], [], 0
        for d, text in enumerate(texts):
            for part in parts_of_text(text or "", self.most):
                if parts and held + len(part) > self.most:
                    yield np.array(owners), np.array([len(p) for p in parts]), self._looked_up(parts)
                    owners, parts, held = [], [], 0
                owners.append(d)
                parts.append(self.split(part))
                held += len(part)
        if parts:
            yield np.array(owners), np.array([len(p) for p in parts]), self._looked_up(parts)

    def values(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """The rows of all words of the texts, one after another, and each text's count of words."""
        sizes, rows = np.zeros(len(texts), dtype=np.int64), [np.zeros((0, self.columns))]
        for owners, counts, values in self.pieces(texts):
            np.add.at(sizes, owners, counts)
            rows.append(values)
        return np.concatenate(rows), sizes

    def sums(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the words' rows for each text, and the counts of words."""
        sizes, out = np.zeros(len(texts), dtype=np.int64), np.zeros((len(texts), self.columns))
        for owners, counts, values in self.pieces(texts):
            np.add.at(sizes, owners, counts)
            some = np.flatnonzero(counts)
            if len(some):
                starts = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
                np.add.at(out, owners[some], np.add.reduceat(values, starts, axis=0))
        return out, sizes


def parts_of_text(text: str, most: int = MOST):
    """The text in parts of about `most` characters, cut before white space, so that no word is cut."""
    at = 0
    while len(text) - at > most:
        found = _SPACE.search(text, at + most)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def runs_of_rows(batch: pa.RecordBatch, column: int, most: int = MOST):
    """Cut an Arrow batch into slices whose texts take at most about `most` bytes, or that are one longer text. Nothing is
    decoded here, so what a worker holds beside the batch itself follows from `most` and the longest text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(first, last - first)
        first = last
