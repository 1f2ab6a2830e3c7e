"""Exact encoding for merge-type SentencePiece models by backtracking, and decoding.

SentencePiece merges, again and again, the adjacent pair whose union is the best piece, leftmost first. The same ids come
out of a left-to-right search: a piece sequence is the merge result exactly when every two neighbours are compatible, that
is, when merging their joined text gives the two back. The search takes the longest piece at each place (one Aho-Corasick
pass gives those of the way without detours, further ones give those of other places as they are needed), falls back to
shorter ones where neighbours are incompatible, and marks places from which no way leads on in a bit field, so each (place,
piece) is tried once.

A text is cut, before the search, at places that no piece spans; what is between recurs, and each worker keeps it.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Memo
from .vocabulary import runs_of_rows

SPACE = "▁"


class BacktrackingEncoder:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.scores = [model.get_score(i) for i in range(len(self.pieces))]
        self.byte_ids: dict[int, int] = {}
        self.ids: dict[str, int] = {}
        self.outputs: list[bytes] = []
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.outputs.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i):
                self.outputs.append(b"")
            elif model.is_unknown(i):
                self.outputs.append(" ⁇ ".encode())
            else:
                self.outputs.append(piece.replace(SPACE, " ").encode())
                if not model.is_unused(i):
                    self.ids[piece] = i
        self.unknown = model.unk_id()
        probe = model.encode("a")
        self.prefix = SPACE if self.pieces[probe[0]].startswith(SPACE) else ""
        if model.encode("a  b ") and model.decode(model.encode(" a  b ")) != " a  b ":
            raise ValueError("only models with identity normalisation are supported")
        self.characters = {c for piece in self.ids for c in piece}
        self.pair_ok: dict[tuple[int, int], bool] = {}
        # Only pieces that merging can reach take part in the search.
        self.usable = {piece: i for piece, i in self.ids.items() if self.merge(piece) == [i]}
        self.lengths = {i: len(piece) for piece, i in self.usable.items()}
        self.shorter = {}
        for piece, i in self.usable.items():
            self.shorter[i] = next((self.usable[piece[:n]] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.usable), -1)
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.usable.items():
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        inner = any(SPACE in piece.lstrip(SPACE) for piece in self.ids)
        if inner:
            self.unit = re.compile(r"(?s).+")
        elif "\n" in self.characters:
            self.unit = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        else:
            self.unit = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        self.memo = Memo(self._unit, 1 << 18)

    def merge(self, text: str) -> list[int]:
        """The plain way: merge the best adjacent pair until none is left. For pieces, pairs of pieces and tests."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        out: list[int] = []
        for part in parts:
            out += [self.ids[part]] if part in self.ids else self.fallback(part)
        return out

    def fallback(self, character: str) -> list[int]:
        data = character.encode("utf-8", "surrogatepass")
        return [self.byte_ids[b] for b in data] if len(self.byte_ids) == 256 else [self.unknown]

    def compatible(self, left: int, right: int) -> bool:
        known = self.pair_ok.get((left, right))
        if known is None:
            known = self.merge(self.pieces[left] + self.pieces[right]) == [left, right]
            if len(self.pair_ok) >= 1 << 20:
                self.pair_ok.clear()
            self.pair_ok[left, right] = known
        return known

    def search(self, text: str) -> list[int]:
        """Ids of a text of known characters only."""
        whole = self.usable.get(text)
        if whole is not None:
            return [whole]
        n = len(text)
        iter_long, longest = self.automaton.iter_long, {}  # place -> longest piece there, -1: none
        for end, (size, i) in iter_long(text):
            longest[end + 1 - size] = i
        open_places = bytearray(b"\x01") * (n + 1)
        lengths, shorter, pair_ok = self.lengths, self.shorter, self.pair_ok
        found: list[int] = []
        at, token = 0, longest.get(0, -1)
        while at < n:
            last = found[-1] if found else -1
            while token >= 0:
                end = at + lengths[token]
                if open_places[end]:
                    ok = True if last < 0 else pair_ok.get((last, token))
                    if ok is None:
                        ok = self.compatible(last, token)
                    if ok:
                        found.append(token)
                        at = end
                        token = longest.get(at) if at < n else -1
                        if token is None:
                            end, (size, i) = next(iter_long(text, at), (n, (0, -1)))
                            token = longest[at] = i if end + 1 - size == at else -1
                        break
                token = shorter[token]
            else:
                open_places[at] = 0
                token = found.pop()
                at -= lengths[token]
        return found

    def encode_unit(self, unit: str) -> list[int]:
        if self.characters.issuperset(unit):
            return self.search(unit)
        out: list[int] = []
        start = 0
        for k, c in enumerate(unit):
            if c not in self.characters:
                if k > start:
                    out += self.search(unit[start:k])
                out += self.fallback(c)
                start = k + 1
        if start < len(unit):
            out += self.search(unit[start:])
        return out

    def _unit(self, unit: str) -> tuple[str, bytes]:
        ids = self.encode_unit(unit)
        return ",".join(map(str, ids)), b"".join(map(self.outputs.__getitem__, ids))

    def units(self, text: str | None) -> list[str]:
        return self.unit.findall(self.prefix + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str | None) -> list[int]:
        return [i for unit in self.units(text) for i in self.encode_unit(unit)]

    def encode_decode(self, text: str | None) -> tuple[str, int, str]:
        """The ids as decimal numbers joined by commas, their count, and the text they decode to."""
        units = self.units(text)
        if not units:
            return "", 0, ""
        ids, data = zip(*map(self.memo.__getitem__, units))
        joined = ",".join(ids)
        return joined, joined.count(",") + 1, self._text(b"".join(data))

    def _text(self, data: bytes) -> str:
        if self.prefix and data.startswith(b" "):
            data = data[1:]
        return data.decode("utf-8", "replace")

    def decode(self, ids) -> str:
        return self._text(b"".join(map(self.outputs.__getitem__, ids)))


@lru_cache(maxsize=2)
def encoder(path: str) -> BacktrackingEncoder:
    return BacktrackingEncoder(path)


def encode(docs: DataFrame, model: str, text: str = "text", key: str = "doc_id", digests: bool = False) -> DataFrame:
    """key, n_tokens, and either ids (array) and decoded text, or with digests=True their SHA-256 values in hexadecimal.

    The ids are those of the SentencePiece library for the whole text, without begin or end ids; `model` is a path that
    holds on every executor. Null and empty texts have no ids and decode to the empty text. Rows may repeat; an empty
    table gives an empty result; other columns are ignored. A worker's memory is that of its cache and its longest text.
    """
    fields = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"

    def run(batches):
        enc = encoder(model)
        for batch in batches:
            for part in runs_of_rows(batch, 1):
                joined, counts, decoded = zip(*map(enc.encode_decode, part.column(1).to_pylist()))
                if digests:
                    sha = lambda values: pa.array([hashlib.sha256(v.encode()).hexdigest() for v in values], pa.string())
                    columns = [sha(joined), sha(decoded)]
                else:
                    flat = np.fromstring(",".join(filter(None, joined)), dtype=np.int32, sep=",")
                    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    columns = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(decoded, pa.string())]
                names = ["doc_id", "n_tokens", *[f.split()[0] for f in fields.split(", ")]]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), *columns], names)

    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, {fields}")
