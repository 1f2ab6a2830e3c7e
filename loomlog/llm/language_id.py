"""Language identification by unigrams over a fixed public vocabulary, summed over all segmentations.

Each language has a probability for every piece. A word's likelihood is the sum, over every way to cut it into pieces, of
the product of their probabilities, which a forward pass over its characters gives; a text's is that of its words. The
piece probabilities come from expectation-maximisation over the same lattices on the words of a bounded sample.
"""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out
from .samples import labelled_texts, stratified_ids
from .vocabulary import WordRows, runs_of_rows

SPACE = "▁"
LONG = 40  # words up to this length need no rescaling: 40 steps of at least FLOOR stay above the smallest double
FLOOR = 1e-7
_SHIFT = 20


class Lattice:
    """All pieces of the vocabulary inside words; piece 0 stands for any character that is no piece itself."""

    def __init__(self, model: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        names = sorted({n.lower() for n in names if "\n" not in n})
        self.size = len(names) + 1
        self.automaton = ahocorasick.Automaton()
        for i, name in enumerate(names):
            self.automaton.add_word(name, len(name) << _SHIFT | (i + 1))
        self.automaton.make_automaton()
        self.single = np.array(sorted(ord(n) for n in names if len(n) == 1), dtype=np.int64)

    def arcs(self, words: list[str]):
        """Start, end (exclusive), piece and size of every arc over the joined words; first and last places of the words."""
        big = "\n".join([SPACE + w for w in words])
        got = np.fromiter(itertools.chain.from_iterable(self.automaton.iter(big)), dtype=np.int64).reshape(-1, 2)
        end, size, piece = got[:, 0] + 1, got[:, 1] >> _SHIFT, got[:, 1] & ((1 << _SHIFT) - 1)
        codes = np.frombuffer(big.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        odd = np.flatnonzero(~np.isin(codes, self.single) & (codes != 10))
        end, size = np.concatenate([end, odd + 1]), np.concatenate([size, np.ones(len(odd), dtype=np.int64)])
        piece = np.concatenate([piece, np.zeros(len(odd), dtype=np.int64)])
        lengths = np.array([len(w) + 1 for w in words], dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        return end - size, end, piece, size, first, first + lengths, len(big)

    def forward(self, words: list[str], p: np.ndarray, learn: np.ndarray | None = None):
        """log of each word's likelihood for each column of p; with learn (weights of the words) also expected counts."""
        start, end, piece, size, first, last, n = self.arcs(words)
        offset = end - np.repeat(first, last - first + 1)[: n + 1][end - 1] if len(end) else end
        order = np.lexsort((size, offset))
        start, end, piece = start[order], end[order], piece[order]
        cuts = np.flatnonzero(np.diff(offset[order] * 64 + size[order])) + 1
        bounds = list(zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(end)]]))) if len(end) else []
        alpha = np.zeros((n + 1, p.shape[1]))
        alpha[first] = 1
        weight = p[piece]
        for a, b in bounds:  # with one offset and size, every start and end is another place
            alpha[end[a:b]] += alpha[start[a:b]] * weight[a:b]
        total = alpha[last]
        if learn is None:
            return np.log(np.maximum(total, 1e-300))
        beta = np.zeros((n + 1, p.shape[1]))
        beta[last] = (learn[:, None] if learn.ndim == 1 else learn) / np.maximum(total, 1e-300)
        for a, b in reversed(bounds):
            beta[start[a:b]] += beta[end[a:b]] * weight[a:b]
        expected = alpha[start] * weight * beta[end]
        counts = np.stack([np.bincount(piece, weights=expected[:, k], minlength=self.size) for k in range(p.shape[1])], axis=1)
        return np.log(np.maximum(total, 1e-300)), counts

    def forward_long(self, word: str, p: np.ndarray) -> np.ndarray:
        """The same for one word of any length, rescaled on the way."""
        start, end, piece, _, _, _, n = self.arcs([word])
        order = np.argsort(end, kind="stable")
        alpha, scale = np.zeros((n + 1, p.shape[1])), np.zeros(p.shape[1])
        alpha[0] = 1
        k, ends, starts, weight = 0, end[order], start[order], p[piece[order]]
        for place in range(1, n + 1):
            while k < len(ends) and ends[k] == place:
                alpha[place] += alpha[starts[k]] * weight[k]
                k += 1
            if place % 16 == 0:
                top = np.maximum(alpha[place], 1e-300)
                alpha[max(0, place - 64) : place + 1] /= top
                scale += np.log(top)
        return np.log(np.maximum(alpha[n], 1e-300)) + scale

    def scores(self, words: list[str], p: np.ndarray) -> np.ndarray:
        out = np.zeros((len(words), p.shape[1]))
        short = [k for k, w in enumerate(words) if len(w) < LONG]
        for at in range(0, len(short), 20_000):
            part = short[at : at + 20_000]
            out[part] = self.forward([words[k] for k in part], p)
        for k, w in enumerate(words):
            if len(w) >= LONG:
                out[k] = self.forward_long(w, p)
        return out


@lru_cache(maxsize=2)
def lattice(model: str) -> Lattice:
    return Lattice(model)


def words_of(text: str | None) -> list[str]:
    return text.lower().replace(SPACE, "_").split() if text else []


class LanguageModel:
    def __init__(self, languages: list[str], p: np.ndarray, model: str):
        self.languages, self.p, self.model = languages, p, model

    def worker(self) -> WordRows:
        lat = lattice(self.model)
        return WordRows(lambda words: lat.scores(words, self.p), len(self.languages), words_of)

    def predict(self, rows: WordRows, texts: list) -> tuple[list[str], np.ndarray]:
        """Language and its posterior. Evidence of long texts is tempered, or every posterior would be 0 or 1."""
        sums, sizes = rows.sums(texts)
        tempered = sums / (1 + sizes[:, None] / 20)
        posterior = np.exp(tempered - tempered.max(axis=1, keepdims=True))
        posterior /= posterior.sum(axis=1, keepdims=True)
        best = posterior.argmax(axis=1)
        has = np.array([any(map(str.isalpha, t or "")) for t in texts], dtype=bool)
        names = [self.languages[b] if h else "und" for b, h in zip(best, has)]
        return names, np.where(has, posterior[np.arange(len(texts)), best], 0.0)


def fit_language_model(
    docs: DataFrame, model: str, text: str = "text", lang: str = "lang", key: str = "doc_id", docs_per_language: int = 1500, words_per_language: int = 40_000, rounds: int = 3
) -> LanguageModel:
    """Piece probabilities from about `docs_per_language` documents of each language that are not held out, of whose words
    the `words_per_language` most frequent count; both bound what comes to the driver. Stretches without white space are
    taken in words of at most 39 characters. Languages are the values of lang whose texts have a word."""
    ids, classes = stratified_ids(docs, lang, docs_per_language, key)
    if not classes:
        raise ValueError("no row with a language may be learned from")
    words = F.regexp_extract_all(F.lower(F.translate(text, SPACE, "_")), F.lit(r"(?U)\S{1,39}"), F.lit(0))
    counts = labelled_texts(docs, ids, text, key).select(F.col(lang).alias("lang"), F.explode(words).alias("word")).groupBy("lang", "word").count()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))
    top = counts.withColumn("place", place).where(F.col("place") <= words_per_language).select("lang", "word", "count").toPandas()
    top = top.sort_values(["lang", "count", "word"], ascending=[True, False, True])
    languages = sorted(top["lang"].unique().tolist()) or sorted(classes)
    lat = lattice(model)
    p = np.full((lat.size, len(languages)), 1.0 / lat.size)
    for k, (_, rows) in enumerate(top.groupby("lang", sort=True)):
        got, weight = rows["word"].tolist(), rows["count"].to_numpy(dtype=float)
        column = p[:, k : k + 1].copy()
        for _ in range(rounds):
            total = np.zeros((lat.size, 1))
            for at in range(0, len(got), 20_000):
                total += lat.forward(got[at : at + 20_000], column, weight[at : at + 20_000])[1]
            column = (total + 0.1) / (total.sum() + 0.1 * lat.size)
            column = np.maximum(column, FLOOR)
        p[:, k] = column[:, 0]
    return LanguageModel(languages, p, model)


def identify(docs: DataFrame, fitted: LanguageModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, held_out, lang_pred and score (0 to 1) of each whole text, from the text alone.

    Null texts and texts without a letter give `und` and score 0. Of equal posteriors, the first language in alphabetical
    order has it. Texts of any length are summed whole, their words looked up in parts. Rows may repeat; an empty table
    gives an empty result; other columns are ignored. The model's size is fixed by the vocabulary and the languages.
    """

    def run(batches):
        rows = fitted.worker()
        for batch in batches:
            for part in runs_of_rows(batch, 1):
                names, scores = fitted.predict(rows, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
