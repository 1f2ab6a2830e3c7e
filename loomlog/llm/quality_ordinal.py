"""Quality by ordinal cumulative-link regression on graded ratings.

One weight vector over hashed features of the text is shared by all grades; K - 1 ordered thresholds cut its score:
P(grade > k) = sigmoid(score - threshold_k). That gives an expected grade and the tail probability that selection uses.
A text's features are those of its words, each counted at its share of the words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out
from .samples import labelled_texts, stratified_ids
from .vocabulary import WordRows, runs_of_rows

BUCKETS = 1 << 16
_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")


def shape(word: str) -> str:
    """Letters as a or A, digits as 0, runs as one, other characters as they are: 'the%%%' -> 'a%%%'."""
    return _DIGITS.sub("0", _LETTERS.sub(lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "a", word))[:12]


def features(word: str) -> tuple[int, int, int]:
    code = lambda s: zlib.crc32(s.encode("utf-8", "surrogatepass")) % BUCKETS
    return code("w" + word.lower()), code("s" + shape(word)), code("e" + word[-3:])


def words_of(text: str | None) -> list[str]:
    return text.split() if text else []


class OrdinalModel:
    def __init__(self, grades: list, weights: np.ndarray, thresholds: np.ndarray):
        self.grades, self.weights, self.thresholds = grades, weights, thresholds

    def worker(self) -> WordRows:
        w = self.weights
        return WordRows(lambda words: w[np.array([features(x) for x in words])].sum(axis=1)[:, None], 1, words_of)

    def tails(self, rows: WordRows, texts: list) -> np.ndarray:
        """P(grade > k) of each text for k = 0 .. K - 2."""
        sums, sizes = rows.sums(texts)
        mean = sums[:, 0] / np.maximum(sizes, 1)
        return 1 / (1 + np.exp(-np.clip(mean[:, None] - self.thresholds[None, :], -30, 30)))


def cells(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A text's features: hashed cells, at most BUCKETS of them, and the share of the words that have each."""
    distinct = Counter(words)
    cells_ = np.array([features(w) for w in distinct], dtype=np.int64).reshape(-1, 3).ravel()
    at, place = np.unique(cells_, return_inverse=True)
    counts = np.bincount(place, weights=np.repeat(np.array(list(distinct.values()), dtype=float), 3), minlength=len(at))
    return at.astype(np.int32), (counts / max(len(words), 1)).astype(np.float32)


def loss(theta: np.ndarray, row: np.ndarray, col: np.ndarray, val: np.ndarray, grade: np.ndarray, share: np.ndarray, weights: int, penalty: float) -> tuple[float, np.ndarray]:
    """The negative log likelihood (with half the penalty on the squared weights) and its gradient by theta: `weights`
    weights, the first threshold, and the logs of the steps to the others."""
    n, classes = len(grade), len(theta) - weights + 1
    steps = np.exp(theta[weights + 1 :])
    thresholds = np.concatenate([theta[weights : weights + 1], steps]).cumsum()
    score = np.bincount(row, weights=val * theta[col], minlength=n)
    tails = 1 / (1 + np.exp(-np.clip(score[:, None] - thresholds, -30, 30)))
    above = np.concatenate([np.ones((n, 1)), tails, np.zeros((n, 1))], axis=1)
    at = np.arange(n)
    upper, lower = above[at, grade], above[at, grade + 1]
    p = np.maximum(upper - lower, 1e-9)
    d_upper, d_lower = upper * (1 - upper) / p * share, lower * (1 - lower) / p * share  # of log p by the two link arguments
    g_cut = np.bincount(grade, weights=-d_upper, minlength=classes)[1:] + np.bincount(grade, weights=d_lower, minlength=classes)[:-1]
    later = g_cut[::-1].cumsum()[::-1]
    later[1:] *= steps
    gradient = -np.concatenate([np.bincount(col, weights=val * (d_upper - d_lower)[row], minlength=weights), later])
    gradient[:weights] += penalty * theta[:weights]
    return float(-(share * np.log(p)).sum() + penalty / 2 * (theta[:weights] ** 2).sum()), gradient


def train_ordinal(texts: Iterable[tuple[np.ndarray, np.ndarray]], grade: np.ndarray, classes: int, rounds: int = 120, penalty: float = 1e-6, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by maximum likelihood (Adam), from the cells of texts and their grades (0 .. classes - 1),
    each text counted at its weight. Thresholds are a first one and positive steps, so they stay in order."""
    n = len(grade)
    share = np.full(n, 1 / n) if weight is None else weight / weight.sum()
    parts, shares = zip(*texts)
    row, col, val = np.repeat(np.arange(n, dtype=np.int32), [len(x) for x in parts]), np.concatenate(parts), np.concatenate(shares)
    del parts, shares
    used, col = np.unique(col, return_inverse=True)
    theta = np.zeros(len(used) + classes - 1)
    cumulative = np.array([share[grade > k].sum() for k in range(classes - 1)]).clip(1e-3, 1 - 1e-3)
    cut = -np.log(cumulative / (1 - cumulative))
    theta[len(used)] = cut[0]
    theta[len(used) + 1 :] = np.log(np.maximum(np.diff(cut), 1e-2))
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        _, gradient = loss(theta, row, col, val, grade, share, len(used), penalty)
        m1, m2 = 0.9 * m1 + 0.1 * gradient, 0.99 * m2 + 0.01 * gradient * gradient
        theta -= 0.3 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
    weights = np.zeros(BUCKETS)
    weights[used] = theta[: len(used)]
    return weights, np.concatenate([theta[len(used) : len(used) + 1], np.exp(theta[len(used) + 1 :])]).cumsum()


def fit_quality(docs: DataFrame, ratings: DataFrame, grade: str = "grade", text: str = "text", key: str = "doc_id", docs_per_grade: int = 1500) -> OrdinalModel:
    """Learn from about `docs_per_grade` rated documents of each grade that are not held out; that bounds the sample. What
    comes to the driver are hashed features, at most BUCKETS numbers for a document, however long it is.
    Grades are the distinct values of the column, in their order. With one grade, every tail is that of the sample."""
    ids, stands_for = stratified_ids(ratings, grade, docs_per_grade, key)

    def run(batches):
        for batch in batches:
            for part in runs_of_rows(batch, 1):
                each = [cells(words_of(t)) for t in part.column(1).to_pylist()]
                lists = [pa.array([x[k] for x in each], pa.list_(kind)) for k, kind in ((0, pa.int32()), (1, pa.float32()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *lists], ["key", "grade", "cells", "shares"])

    sample = labelled_texts(docs, ids, text, key).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(grade).alias("grade"))
    kinds = dict(sample.dtypes)
    rows = sample.mapInArrow(run, f"key {kinds['key']}, grade {kinds['grade']}, cells array<int>, shares array<float>").toPandas().sort_values("key", kind="stable")
    grades = sorted(rows["grade"].unique().tolist())
    if len(grades) < 2:
        return OrdinalModel(grades or [0], np.zeros(BUCKETS), np.zeros(0))
    place = {g: k for k, g in enumerate(grades)}
    weights, thresholds = train_ordinal(zip(rows["cells"], rows["shares"]), rows["grade"].map(place).to_numpy(), len(grades), weight=rows["grade"].map(stands_for).to_numpy(dtype=float))
    return OrdinalModel(grades, weights, thresholds)


def rate(docs: DataFrame, model: OrdinalModel, at_least=None, select_from: float = 0.5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, held_out, expected_grade, tail_probability (of a grade of `at_least` or better, by default above the lowest)
    and selected (tail_probability >= select_from) of each whole text.

    Null and empty texts have no words and are rated by the thresholds alone. Texts of any length are rated whole, their
    words looked up in parts. Rows may repeat; an empty table gives an empty result; other columns are ignored.
    """
    grades = model.grades
    cut = grades.index(at_least) - 1 if at_least is not None else 0

    def run(batches):
        rows = model.worker()
        steps = np.diff(np.array(grades, dtype=float))
        for batch in batches:
            for part in runs_of_rows(batch, 1):
                tails = model.tails(rows, part.column(1).to_pylist())
                expected = grades[0] + tails @ steps
                tail = tails[:, cut] if 0 <= cut < tails.shape[1] else np.ones(len(tails))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(expected, pa.float64()), pa.array(tail, pa.float64())], ["doc_id", "expected_grade", "tail_probability"])

    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {kind}, expected_grade double, tail_probability double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= select_from).alias("selected"))
