"""Token counts of byte-level BPE vocabularies, without producing tokens.

A word's symbols form a linked list, and a heap holds its adjacent pairs by (rank, place). Popping the lowest-ranked pair
that is still current and joining it costs one symbol each time, so the count is symbols at first minus merges.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import Memo
from .vocabulary import runs_of_rows


def byte_alphabet() -> list[str]:
    """Byte-level vocabularies write each byte as a printable character: itself where printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class HeapCounter:
    """Reads a tokenizers .json: NFC, white-space and lower-case normalisers, one Split by regex, ByteLevel, BPE."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("this tokenizer's parts are not supported")
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if (split["type"], split["behavior"], split["invert"], level["type"]) != ("Split", "Removed", True, "ByteLevel"):
            raise ValueError("this tokenizer's parts are not supported")
        self.token = regex.compile(split["pattern"]["Regex"])
        self.suffix = model["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(a, b): (rank, a + b) for rank, (a, b) in enumerate(pairs)}
        self.bytes = byte_alphabet()
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))
        self.special_mark = "<|" if all(t["content"].startswith("<|") for t in spec["added_tokens"]) else ""
        # White space to Python that is none to the tokenizer: such texts are cut by the pattern itself.
        self.odd = re.compile("[\x1c-\x1f]")
        self.memo = Memo(self.chunk, 1 << 18)

    def merged(self, symbols: list[str]) -> int:
        """Symbols that remain after all merges."""
        n, ranks = len(symbols), self.ranks
        if n < 2:
            return n
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for k in range(n - 1):
            r = ranks.get((symbols[k], symbols[k + 1]))
            if r is not None:
                heap.append((r[0], k, r[1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, k, joined = heapq.heappop(heap)
            right = after[k]
            if symbols[k] is None or right >= n or symbols[k] + symbols[right] != joined or ranks.get((symbols[k], symbols[right]), (-1,))[0] != _:
                continue  # a neighbour has changed since this pair was pushed
            merges += 1
            symbols[k], symbols[right] = joined, None
            after[k] = following = after[right]
            if following < n:
                before[following] = k
                r = ranks.get((joined, symbols[following]))
                if r is not None:
                    heapq.heappush(heap, (r[0], k, r[1]))
            previous = before[k]
            if previous >= 0:
                r = ranks.get((symbols[previous], joined))
                if r is not None:
                    heapq.heappush(heap, (r[0], previous, r[1]))
        return n - merges

    def chunk(self, chunk: str) -> int:
        """Tokens of a stretch that holds no ASCII white space (or of any text without special tokens)."""
        text = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        alphabet, total = self.bytes, 0
        for word in self.token.findall(text):
            symbols = [alphabet[b] for b in word.encode("utf-8", "surrogatepass")]
            symbols[-1] += self.suffix
            total += self.merged(symbols)
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special_mark in text and (found := self.special.findall(text)):
            return len(found) + sum(map(self.count_plain, self.special.split(text)))
        return self.count_plain(text)

    def count_plain(self, text: str) -> int:
        if self.odd.search(text):
            return self.chunk(text)
        return sum(map(self.memo.__getitem__, text.split()))


@lru_cache(maxsize=2)
def counter(path: str) -> HeapCounter:
    return HeapCounter(path)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes, n_tokens and over_limit (n_tokens > limit) of each whole text, as the tokenizers library counts.

    Special strings inside a text count as their special tokens, the library's default; nothing is added, cut or padded.
    Null and empty texts have 0 bytes and tokens. Rows may repeat; an empty table gives an empty result; other columns
    are ignored. `tokenizer` is a path that holds on every executor.
    """

    def run(batches):
        count = counter(tokenizer).count
        for batch in batches:
            for part in runs_of_rows(batch, 1):
                counts = pa.array(map(count, part.column(1).to_pylist()), pa.int64())
                sizes = pc.fill_null(pc.binary_length(part.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), sizes, counts, pc.greater(counts, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
