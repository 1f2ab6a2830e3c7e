"""Toxic spans by a linear-chain conditional random field over words, and document scores from its marginals.

Documents are labelled, words are not, so words get labels first: in a toxic document, a word is labelled toxic if it
occurs in toxic documents far more often than the share of toxic documents explains (binomial test over the sample,
corrected for the number of words). The field, two states with word, prefix and suffix features, is trained on windows of
such labelled words. Forward-backward gives every word's marginal; what a document's marginals add up to is calibrated
against the documents' labels.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialize
from .samples import labelled_texts, stratified_ids
from .vocabulary import WordRows, runs_of_rows

_JUNK = re.compile(r"[\W_]+")
_WORD = re.compile(r"\S+")
BUCKETS = 1 << 14
CLIP = 30.0
TOGETHER = 1 << 22  # bytes of text scored at once: steps along the chains cost the same for one document as for many


def clean(word: str) -> str:
    return word if word.isalpha() else _JUNK.sub("", word)


def words_of(text: str | None) -> list[str]:
    """Lower-case words; what is neither letter nor digit is left out of them, so a word may be empty."""
    return text.lower().split() if text else []


def affixes(word: str) -> tuple[int, int]:
    return zlib.crc32(("<" + word[:4]).encode("utf-8", "surrogatepass")) % BUCKETS, zlib.crc32((word[-4:] + ">").encode("utf-8", "surrogatepass")) % BUCKETS


def odds_forward_backward(gain: np.ndarray, lengths: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Odds of state 1 from what precedes (itself included), and from what follows, at each place.

    gain[t, d]: exp(emission of state 1 less that of state 0) at place t of document d; documents are sorted by falling
    length; change[a, b]: exp(score of b after a). Each is a ratio, so nothing over- or underflows.
    """
    steps, n = gain.shape
    before, after = np.zeros((steps, n)), np.ones((steps, n))
    live = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right")  # documents that reach place t
    (c00, c01), (c10, c11) = change
    if steps:
        before[0] = gain[0]
    for t in range(1, steps):
        k = live[t]
        r = before[t - 1, :k]
        before[t, :k] = gain[t, :k] * (c01 + c11 * r) / (c00 + c10 * r)
    for t in range(steps - 2, -1, -1):
        k = live[t + 1]
        x = gain[t + 1, :k] * after[t + 1, :k]
        after[t, :k] = (c10 + c11 * x) / (c00 + c01 * x)
    return before, after


class ToxicityModel:
    def __init__(self, words: dict[str, int], weights: np.ndarray, change: np.ndarray, calibration: np.ndarray, base: float | None = None):
        self.words, self.weights, self.change, self.calibration, self.base = words, weights, change, calibration, base

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), 1))
        w, known, bias = self.weights, self.words, self.weights[-1]
        for k, word in enumerate(words):
            word = clean(word)
            a, b = affixes(word)
            i = known.get(word)
            out[k, 0] = bias + w[len(known) + a] + w[len(known) + BUCKETS + b] + (w[i] if i is not None else 0.0)
        return np.exp(np.clip(out, -CLIP, CLIP))

    def worker(self) -> WordRows:
        return WordRows(self.emissions, 1, words_of)

    def marginals(self, rows: WordRows, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """The probability of state 1 of all words of all texts, one after another, and the texts' counts of words."""
        gains, sizes = rows.values(texts)
        gains, out = gains[:, 0], np.zeros(len(gains))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        at = 0
        while at < len(order):  # documents of like length together, at most about 2 million places at once
            longest = sizes[order[at]]
            end = min(len(order), at + max(1, int(2_000_000 // longest)), max(at + 1, int(np.searchsorted(-sizes[order], -(longest // 2), side="right"))))
            part = order[at:end]
            places = starts[part][None, :] + np.arange(longest)[:, None]
            inside = np.arange(longest)[:, None] < sizes[part][None, :]
            gain = np.where(inside, gains[np.where(inside, places, 0)], 1.0)
            before, after = odds_forward_backward(gain, sizes[part], self.change)
            odds = before * after
            out[places[inside]] = (odds / (1 + odds))[inside]
            at = end
        return out, sizes

    def evidence(self, marginals: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each document: 1, the log odds that some word is toxic, and the log of the expected number of such words."""
        out = np.zeros((len(sizes), 3))
        out[:, 0] = 1
        some = np.flatnonzero(sizes)
        if len(marginals):
            starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
            none = np.add.reduceat(np.log1p(-np.minimum(marginals, 1 - 1e-9)), starts)
            out[some, 1] = np.log(np.maximum(-np.expm1(none), 1e-9)) - none
            out[some, 2] = np.log1p(np.add.reduceat(np.where(marginals > 0.05, marginals, 0), starts))
        out[:, 1] = np.clip(np.where(sizes > 0, out[:, 1], -10), -10, 10)
        return out

    def scores(self, marginals: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if self.base is not None:
            return np.full(len(sizes), self.base)
        return 1 / (1 + np.exp(-np.clip(self.evidence(marginals, sizes) @ self.calibration, -CLIP, CLIP)))


def toxic_words(counts: list[tuple[str, int, int]], n_bad: int, n_all: int, words_in_bad: int, alpha: float = 0.01) -> set[str]:
    """Of (word, toxic documents with it, documents with it), those that toxic documents have more often than chance, at a
    rate of at least ten to one; words_in_bad: how many words were looked at."""
    if not 0 < n_bad < n_all:
        return set()
    share, limit = n_bad / n_all, math.log(alpha / max(1, words_in_bad))
    found = set()
    for word, k, n in counts:
        rate_bad, rate_good = (k + 0.5) / (n_bad + 1), (n - k + 0.5) / (n_all - n_bad + 1)
        if not word or k < 3 or rate_bad < 10 * rate_good:
            continue
        # Chernoff bound of the binomial tail: P(at least k of n) <= exp(-n * KL(k/n, share))
        q = k / n
        kl = q * math.log(q / share) + ((1 - q) * math.log((1 - q) / (1 - share)) if q < 1 else 0.0)
        if -n * kl < limit:
            found.add(word)
    return found


def windows_of(key, words: list[str], toxic: bool, bad: set[str], window: int) -> list[tuple[list[str], list[int]]]:
    """Stretches of the words, with their labels, around toxic ones; of a clean document, one around a word that its key picks."""
    cleaned = [clean(w) for w in words]
    if toxic:
        at = [t for t, w in enumerate(cleaned) if w in bad]  # none: toxic by its label, but nothing says which words
    else:
        at = [t for t in (zlib.crc32(str(key).encode()) % len(words),)] if words else []
    out, last = [], -1
    for t in at:
        if t > last:
            a, last = max(0, t - window), min(len(words), t + window + 1)
            shown = [w if len(w) <= 64 else w[:32] + w[-32:] for w in words[a:last]]
            out.append((shown, [int(toxic and w in bad) for w in cleaned[a:last]]))
    return out


def field_loss(weights: np.ndarray, pairs: np.ndarray, index: np.ndarray, y: np.ndarray, lengths: np.ndarray, inside: np.ndarray, penalty: float = 0.05) -> tuple[float, np.ndarray]:
    """Negative log likelihood of the labels y of all windows (with half the penalty on squared weights), and its gradient
    by the weights (the last but one is the bias, the last is always 0) and the scores of pairs of neighbouring labels."""
    none = len(weights) - 1
    score = np.where(inside, np.clip(weights[index].sum(axis=2) + weights[none - 1], -CLIP, CLIP), 0.0)
    gain, change, both = np.exp(score), np.exp(pairs), inside[1:]
    before, after = odds_forward_backward(gain, lengths, change)
    odds = before * after
    off = np.where(inside, odds / (1 + odds) - y, 0.0)
    grad = np.bincount(index.ravel(), weights=np.repeat(off.ravel(), 3), minlength=none + 1)
    grad[none - 1], grad[none] = off.sum(), 0
    # Joint odds of neighbours, relative to (0, 0).
    x = gain[1:] * after[1:]
    joint = np.stack([np.full_like(x, change[0, 0]), change[0, 1] * x, change[1, 0] * before[:-1], change[1, 1] * before[:-1] * x])
    joint = np.where(both, joint / joint.sum(axis=0), 0.0).sum(axis=(1, 2)).reshape(2, 2)
    seen = np.array([[(both & (y[:-1] == a) & (y[1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])
    full = np.concatenate([grad + penalty * weights, (joint - seen + penalty * pairs).ravel()])
    full[none] = 0
    # log of the sum over labellings: state 0 all along, and each step's factor (c00 + c10 r) of the forward odds r.
    t = np.arange(len(lengths))
    norm = np.where(both, np.log(change[0, 0] + change[1, 0] * before[:-1]), 0.0).sum() + np.log1p(before[lengths - 1, t]).sum()
    loss = norm - (score * y).sum() - (seen * pairs).sum() + penalty / 2 * ((weights**2).sum() + (pairs**2).sum())
    return float(loss), full


def train_field(windows: list[list[str]], labels: list[list[int]], known: dict[str, int], rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood (with a small penalty) by Adam; gradients from forward-backward over all windows at once."""
    order = sorted(range(len(windows)), key=lambda k: -len(windows[k]))
    lengths = np.array([len(windows[k]) for k in order])
    steps, n, none = int(lengths[0]), len(order), len(known) + 2 * BUCKETS + 1
    index = np.full((steps, n, 3), none, dtype=np.int64)
    y = np.zeros((steps, n), dtype=np.int64)
    inside = np.arange(steps)[:, None] < lengths[None, :]
    for d, k in enumerate(order):
        for t, word in enumerate(windows[k]):
            word = clean(word)
            a, b = affixes(word)
            index[t, d] = known.get(word, none), len(known) + a, len(known) + BUCKETS + b
            y[t, d] = labels[k][t]
    weights, pairs = np.zeros(none + 1), np.zeros((2, 2))
    weights[none - 1] = -3.0
    m1, m2 = np.zeros(none + 5), np.zeros(none + 5)
    for step in range(1, rounds + 1):
        _, full = field_loss(weights, pairs, index, y, lengths, inside)
        m1, m2 = 0.9 * m1 + 0.1 * full, 0.99 * m2 + 0.01 * full * full
        move = 0.25 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        weights -= move[: none + 1]
        pairs -= move[none + 1 :].reshape(2, 2)
    return weights[:none], np.exp(pairs)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", toxic_docs: int = 3000, other_docs: int = 6000, window: int = 12, max_windows: int = 6000, seed: int = 7
) -> ToxicityModel:
    """Learn from about toxic_docs + other_docs labelled documents that are not held out; these numbers bound the sample,
    and max_windows the windows of words that the field is trained on. The sample's texts stay on the executors: to the
    driver come word counts, windows of words, and three numbers for each document. Without both labels among them every
    score is the share of toxic ones (0 without any)."""
    ids, stands_for = stratified_ids(labels, label, {1: toxic_docs, 0: other_docs}, key)
    columns = [F.col(key).cast("string").alias("key"), F.col(text).alias("text"), F.col(label).cast("int").alias("label")]
    sample = materialize(labelled_texts(docs, ids, text, key).select(*columns), "toxicity-sample")
    sizes = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    n_bad, n_all = sizes.get(1, 0), sum(sizes.values())
    if not 0 < n_bad < n_all:
        return ToxicityModel({}, np.zeros(2 * BUCKETS + 1), np.ones((2, 2)), np.zeros(3), n_bad / n_all if n_all else 0.0)

    def words_in(batches):
        for batch in batches:
            for part in runs_of_rows(batch, 1):
                own = [sorted({clean(w) for w in words_of(t)}) for t in part.column(1).to_pylist()]
                label_ = np.repeat(np.array(part.column(2).to_pylist()), [len(x) for x in own])
                yield pa.RecordBatch.from_arrays([pa.array([w for x in own for w in x], pa.string()), pa.array(label_, pa.int32())], ["word", "label"])

    counts = sample.mapInArrow(words_in, "word string, label int").groupBy("word").agg(F.sum("label").cast("long").alias("bad"), F.count(F.lit(1)).alias("docs")).where("bad > 0")
    counts = materialize(counts, "toxicity-words")
    rate = (F.col("bad") + 0.5) / (n_bad + 1) >= 10 * (F.col("docs") - F.col("bad") + 0.5) / (n_all - n_bad + 1)
    often = [tuple(r) for r in counts.where("bad >= 3").where(rate).orderBy("word").collect()]
    bad = toxic_words(often, n_bad, n_all, counts.count())

    def cut(batches):
        for batch in batches:
            for part in runs_of_rows(batch, 1):
                for key_, t, label_ in zip(*(c.to_pylist() for c in part.columns)):
                    got = windows_of(key_, words_of(t), bool(label_), bad, window)
                    if got:
                        order = [zlib.crc32(f"{seed} {key_} {k}".encode()) for k in range(len(got))]
                        lists = [pa.array([x[k] for x in got], pa.list_(kind)) for k, kind in ((0, pa.string()), (1, pa.int32()))]
                        yield pa.RecordBatch.from_arrays([pa.array(order, pa.int64()), pa.array([key_] * len(got), pa.string()), *lists], ["order", "key", "words", "marks"])

    picked = sample.mapInArrow(cut, "order long, key string, words array<string>, marks array<int>").orderBy("order", "key").limit(max_windows).collect()
    windows, marks = [list(r.words) for r in picked], [list(r.marks) for r in picked]
    common = Counter(clean(w) for window_ in windows for w in window_)
    known = {w: i for i, w in enumerate(sorted({w for w, n in common.items() if n >= 3} | bad))}
    weights, change = train_field(windows, marks, known) if windows else (np.zeros(len(known) + 2 * BUCKETS + 1), np.ones((2, 2)))
    model = ToxicityModel(known, weights, change, np.zeros(3))

    def evidence(batches):
        table = model.worker()
        for batch in batches:
            for part in runs_of_rows(batch, 1):
                x = model.evidence(*model.marginals(table, part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array(x[:, k]) for k in range(3))], ["key", "label", "x0", "x1", "x2"])

    # Calibrated on the documents' labels, each class at the weight that its labelled rows have.
    rows = sample.mapInArrow(evidence, "key string, label int, x0 double, x1 double, x2 double").toPandas().sort_values("key", kind="stable")
    each = rows["label"].map(stands_for).to_numpy(dtype=float)
    model.calibration = calibrate(rows[["x0", "x1", "x2"]].to_numpy(), rows["label"].to_numpy(dtype=float), each / each.mean())
    return model


def calibrate(x: np.ndarray, target: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression (with a small penalty) by Newton steps, each row counted at its weight."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -CLIP, CLIP)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        beta -= np.linalg.solve(hessian, x.T @ (weight * (p - target)) + 1e-2 * beta)
    return beta


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, span_threshold: float = 0.5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, held_out, score, predicted (score >= threshold) and spans: [start, end) code points of words whose marginal is
    at least span_threshold, with it. Null and empty texts have no words, get the score of no evidence and no spans. Texts
    of any length are one chain, scored whole; a worker then holds a few numbers for each word. Rows may repeat; an empty
    table gives an empty result; other columns are ignored."""

    def run(batches):
        rows = model.worker()
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))
        for batch in batches:
            for part in runs_of_rows(batch, 1, TOGETHER):
                texts = part.column(1).to_pylist()
                marginals, sizes = model.marginals(rows, texts)
                scores = model.scores(marginals, sizes)
                ends = np.cumsum(sizes)
                hot = np.flatnonzero(marginals >= span_threshold)
                spans: list[list] = [[] for _ in texts]
                for d in np.unique(np.searchsorted(ends, hot, side="right")):
                    first = ends[d] - sizes[d]
                    own = marginals[first : ends[d]]
                    # lower() can change a text's length, never the number or order of its words
                    where = [m.span() for m in _WORD.finditer(texts[d])] if len(texts[d].split()) == sizes[d] else []
                    spans[d] = [{"start": where[t][0], "end": where[t][1], "marginal": float(own[t])} for t in np.flatnonzero(own >= span_threshold) if t < len(where)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {kind}, score double, spans array<struct<start:int,end:int,marginal:double>>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of docs that score below threshold, with all their columns; for nulls, empty and long texts see score. A model
    that was not given both labels cannot tell documents apart, and all stay."""
    if model.base is not None:
        return docs
    at = docs.columns.index(text)

    def run(batches):
        rows = model.worker()
        for batch in batches:
            for part in runs_of_rows(batch, at, TOGETHER):
                scores = model.scores(*model.marginals(rows, part.column(at).to_pylist()))
                yield part.filter(pa.array(scores < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
