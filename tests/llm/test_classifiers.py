import itertools
import os
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomlog.llm import quality_ordinal
from loomlog.llm.common import is_held_out
from loomlog.llm.language_id import LanguageModel, Lattice, fit_language_model, identify
from loomlog.llm.quality_ordinal import OrdinalModel, cells, features, fit_quality, loss, rate, train_ordinal
from loomlog.llm.toxicity_crf import BUCKETS, ToxicityModel, drop_toxic, field_loss, fit_toxicity, odds_forward_backward, score, train_field
from loomlog.llm.vocabulary import WordRows

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not there")


def segmentations(word, pieces):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in pieces:
            for rest in segmentations(word[n:], pieces):
                yield [word[:n], *rest]


def test_forward_sums_all_segmentations(rng):
    lat = Lattice(MODEL)
    p = np.random.default_rng(1).random((lat.size, 2)) / 50
    pieces = {w: v & ((1 << 20) - 1) for w, v in lat.automaton.items()}
    for word in ("the", "tion", "a", "zzq", "inger", "x€"):
        known = pieces | {c: 0 for c in word if c not in pieces}
        total = sum(np.prod([p[known[s]] for s in cut], axis=0) for cut in segmentations("▁" + word, known))
        assert np.allclose(np.exp(lat.forward([word], p)[0]), total)
    long = "theand" * 30
    assert np.isclose(lat.scores([long], p)[0, 0], lat.forward_long(long, p)[0]) and np.isfinite(lat.scores(["é" * 5000], p)).all()
    short = "theandofthing"
    assert np.allclose(lat.forward([short], p)[0], lat.forward_long(short, p))


def test_expected_counts_add_up():
    lat = Lattice(MODEL)
    p = np.full((lat.size, 1), 0.01)
    _, counts = lat.forward(["the", "and"], p, np.array([2.0, 1.0]))
    assert counts.sum() >= 3 and np.isfinite(counts).all()


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(5)
    emit, change = rng.normal(size=(5, 3)), np.exp(rng.normal(size=(2, 2)))
    lengths = np.array([5, 3, 1])
    before, after = odds_forward_backward(np.exp(emit), lengths, change)
    for d, n in enumerate(lengths):
        weight = np.zeros((n, 2))
        for path in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(emit[t, d] * s for t, s in enumerate(path))) * np.prod([change[a, b] for a, b in zip(path, path[1:])])
            for t, s in enumerate(path):
                weight[t, s] += w
        assert np.allclose((before * after)[:n, d], weight[:, 1] / weight[:, 0])


def test_field_learns_its_words():
    windows = [["a", "bad", "b"], ["a", "b", "c"], ["bad", "worse"]] * 20
    weights, change = train_field(windows, [[0, 1, 0], [0, 0, 0], [1, 1]] * 20, {"bad": 0, "a": 1, "b": 2, "worse": 3, "c": 4})
    assert weights[0] > 0.5 and weights[3] > 0.5 and weights[1] < 0.5 and (change > 0).all()


def test_field_gradient_by_finite_differences():
    rng = np.random.default_rng(6)
    lengths = np.array([5, 4, 2, 1])
    inside = np.arange(5)[:, None] < lengths[None, :]
    index, y = rng.integers(0, 6, (5, 4, 3)), rng.integers(0, 2, (5, 4)) * inside
    index[~inside] = 7  # of eight weights, the last is the one that is always 0, the one before is the bias
    weights, pairs = np.append(rng.normal(size=7), 0), rng.normal(size=(2, 2))
    _, gradient = field_loss(weights, pairs, index, y, lengths, inside)
    for k in range(12):
        if k == 7:
            continue
        ends = []
        for sign in (1, -1):
            w, p = weights.copy(), pairs.copy()
            if k < 8:
                w[k] += sign * 1e-5
            else:
                p.flat[k - 8] += sign * 1e-5
            ends.append(field_loss(w, p, index, y, lengths, inside)[0])
        assert np.isclose((ends[0] - ends[1]) / 2e-5, gradient[k], rtol=1e-4, atol=1e-5)


def test_ordinal_orders_four_grades():
    rng = np.random.default_rng(2)
    grade = rng.integers(0, 4, 400)
    texts = [["good"] * int(g) * 2 + ["bad"] * int(3 - g) * 2 + [f"w{rng.integers(50)}"] * 2 for g in grade]
    weights, thresholds = train_ordinal(map(cells, texts), grade, 4)
    assert (np.diff(thresholds) > 0).all() and np.count_nonzero(weights)
    model = OrdinalModel([0, 1, 2, 3], weights, thresholds)
    tails = model.tails(model.worker(), [" ".join(["good"] * 2 * g + ["bad"] * 2 * (3 - g) + ["w1"] * 2) for g in range(4)])
    expected = tails.sum(axis=1)
    assert (np.diff(expected) > 0.5).all() and np.abs(expected - np.arange(4)).max() < 0.5 and (np.diff(tails, axis=1) <= 0).all()


def test_ordinal_gradient_by_finite_differences():
    rng = np.random.default_rng(4)
    n, used, classes = 12, 5, 4
    row, col, val = rng.integers(0, n, 40), rng.integers(0, used, 40), rng.random(40)
    grade, share = rng.integers(0, classes, n), rng.random(n)
    theta = rng.normal(size=used + classes - 1)
    value, gradient = loss(theta, row, col, val, grade, share, used, 0.1)
    for k in range(len(theta)):
        step = np.zeros_like(theta)
        step[k] = 1e-5
        slope = (loss(theta + step, row, col, val, grade, share, used, 0.1)[0] - loss(theta - step, row, col, val, grade, share, used, 0.1)[0]) / 2e-5
        assert np.isclose(slope, gradient[k], rtol=1e-4, atol=1e-7)


def test_cells_are_shares_of_the_words():
    at, share = cells("the cat the".split())
    want = Counter()
    for w in "the cat the".split():
        want.update({c: n / 3 for c, n in Counter(features(w)).items()})
    assert dict(zip(at.tolist(), share.tolist())) == pytest.approx(dict(want))
    assert len(cells([])[0]) == 0


def test_language_score_is_the_tempered_sum(spark):
    """A text's score from its words' forward sums, word by word; long texts in parts give the same."""
    lat = Lattice(MODEL)
    rng = np.random.default_rng(8)
    model = LanguageModel(["a", "b", "c"], rng.random((lat.size, 3)) / 100, MODEL)
    texts = ["the and of this", "Une  autre\tphrase", "x" * 60 + " the", ""]
    names, scores = model.predict(model.worker(), texts)
    for text, name, value in zip(texts[:3], names, scores):
        words = text.lower().split()
        total = sum(np.log(np.maximum(np.exp(lat.scores([w], model.p)[0]), 1e-300)) if len(w) < 40 else lat.scores([w], model.p)[0] for w in words)
        weight = np.exp((total - total.max()) / (1 + len(words) / 20))
        assert name == "abc"[int(total.argmax())] and np.isclose(value, weight.max() / weight.sum())
    assert (names[3], scores[3]) == ("und", 0.0)
    rows = model.worker()
    rows.most = 20
    assert model.predict(rows, texts)[0] == names and np.allclose(model.predict(rows, texts)[1], scores)


def test_toxicity_score_and_spans_by_enumeration(spark):
    """Spans and evidence of short texts, from all labellings of their words."""
    words = {"bad": 0, "worse": 1, "fine": 2}
    weights = np.zeros(len(words) + 2 * BUCKETS + 1)
    weights[:3], weights[-1] = (4.0, 3.0, -1.0), -1.0
    model = ToxicityModel(words, weights, np.array([[2.0, 0.5], [0.7, 1.5]]), np.array([-1.0, 0.8, 0.3]))
    texts = ["It is BAD, worse!", "fine fine fine", "bad", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in score(docs, model).collect():
        tokens = (texts[r.doc_id] or "").split()
        gains = [float(model.emissions([w.lower()])[0, 0]) for w in tokens]
        total, one = 0.0, np.zeros(len(tokens))
        for path in itertools.product((0, 1), repeat=len(tokens)):
            w = np.prod([g if s else 1 for g, s in zip(gains, path)]) * np.prod([model.change[a, b] for a, b in zip(path, path[1:])])
            total += w
            one += w * np.array(path)
        marginal = one / total
        none = np.log1p(-marginal).sum()
        x = np.array([1, np.clip(np.log(np.maximum(-np.expm1(none), 1e-9)) - none, -10, 10) if tokens else -10, np.log1p(marginal[marginal > 0.05].sum())])
        assert np.isclose(r.score, 1 / (1 + np.exp(-x @ model.calibration)))
        at = [m.span() for m in re.finditer(r"\S+", texts[r.doc_id] or "")]
        assert [(s.start, s.end) for s in r.spans] == [at[t] for t in np.flatnonzero(marginal >= 0.5)]
        assert np.allclose([s.marginal for s in r.spans], marginal[marginal >= 0.5])


def test_words_in_parts_give_the_same(rng):
    texts = [" ".join(rng.choice(["ab", "c", "déf", "gh"]) for _ in range(rng.randint(0, 200))) for _ in range(20)] + ["x" * 500, "", None]
    rows = WordRows(lambda words: np.array([[len(w), 1.0] for w in words]), 2, lambda t: t.split(), limit=3, most=30)
    values, sizes = rows.values(texts)
    sums, again = rows.sums(texts)
    words = [(t or "").split() for t in texts]
    assert sizes.tolist() == again.tolist() == [len(w) for w in words]
    assert values[:, 0].tolist() == [len(w) for ws in words for w in ws] and sums[:, 0].tolist() == [sum(map(len, w)) for w in words]


@tables
def test_language_held_out_accuracy(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit_language_model(docs, MODEL)
    out = identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == is_held_out(r.doc_id) for r in out) and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    odd = identify(odd_docs, model).collect()
    assert [r.lang_pred for r in odd[:3]] == ["und"] * 3 and len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert identify(no_docs, model).count() == 0


@tables
def test_toxicity_held_out(spark, odd_docs, no_docs):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = fit_toxicity(docs, labels)
    out = score(docs, model).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r for r in out if r.toxic], [r for r in out if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.75 * len(toxic) and sum(r.predicted for r in clean) <= 0.01 * len(clean)
    odd = score(odd_docs.union(odd_docs.limit(1).withColumn("text", F.lit("you are an idiot, a stupid clown and a moron"))), model).collect()
    assert odd[-1].predicted == 1 and [s.start for s in odd[-1].spans] and all(r.predicted == 0 for r in odd[:-1])
    assert drop_toxic(odd_docs, model).count() == odd_docs.count() and score(no_docs, model).count() == 0
    one = fit_toxicity(odd_docs, odd_docs.select("doc_id", F.lit(0).alias("toxic")))
    assert {r.score for r in score(odd_docs, one).collect()} == {0.0}


@tables
def test_quality_held_out(spark, odd_docs, no_docs):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = fit_quality(docs, labels.select("doc_id", F.when(F.col("quality") == 0, 0).otherwise(2 - F.col("toxic")).alias("grade")))
    out = rate(docs, model).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r for r in out if r.quality], [r for r in out if not r.quality]
    assert sum(r.selected for r in good) >= 0.95 * len(good) and sum(not r.selected for r in bad) >= 0.5 * len(bad)
    assert len(rate(odd_docs, model, at_least=2).collect()) == odd_docs.count() and rate(no_docs, model).count() == 0
    one = fit_quality(odd_docs, odd_docs.select("doc_id", F.lit(1).alias("grade")))
    assert {r.expected_grade for r in rate(odd_docs, one).collect()} == {1.0}


def test_ratings_equal_the_plain_cumulative_link(spark):
    """expected grade and tails from the chances of the single grades, one word after another."""
    draws = np.random.default_rng(7)
    model = OrdinalModel([0, 1, 3], draws.normal(size=quality_ordinal.BUCKETS), np.array([-0.6, 0.8]))
    words = ["the", "Thing", "THING", "x1", "2024", "é", "long-winded", "ünter", "a" * 50]
    texts = [None, "", " \n", *(" ".join(draws.choice(words, size=draws.integers(1, 60))) for _ in range(60)), "the Thing " * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for at_least, least in ((None, 1), (1, 1), (3, 3), (0, 0)):
        rows = rate(docs, model, at_least=at_least, select_from=0.4).collect()
        assert len(rows) == len(texts)
        for r in rows:
            held = (texts[r.doc_id] or "").split()
            total = sum(model.weights[c] * n for w, n in Counter(held).items() for c in features(w))
            link = total / len(held) if held else 0.0
            upto = [1 / (1 + np.exp(link - t)) for t in model.thresholds]  # P(grade <= k)
            chances = dict(zip(model.grades, (upto[0], upto[1] - upto[0], 1 - upto[1])))
            assert abs(r.expected_grade - sum(g * p for g, p in chances.items())) < 1e-9
            tail = sum(p for g, p in chances.items() if g >= least)
            assert abs(r.tail_probability - tail) < 1e-9 and r.selected == (r.tail_probability >= 0.4) and r.held_out == is_held_out(r.doc_id)


def test_scores_do_not_depend_on_the_classes_limits(spark):
    """Three in ten rows with the same word are toxic: that is the score, also where few other rows are taken."""
    rows = [(k, "some odd words here" if k % 10 else "some vile words here") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 10 == 0 or k % 10 in (1, 2))) for k in range(3000)], "doc_id long, toxic int")
    wanted = [score(docs.limit(2), fit_toxicity(docs, labels, other_docs=n)).orderBy("doc_id").collect()[1].score for n in (6000, 150)]
    assert abs(wanted[0] - 2 / 9) < 0.05 and abs(wanted[1] - wanted[0]) < 0.05
    grades = labels.select("doc_id", (1 - F.col("toxic")).alias("grade"))
    tails = [rate(docs.limit(2), fit_quality(docs, grades, docs_per_grade=n)).orderBy("doc_id").collect()[1].tail_probability for n in (6000, 150)]
    assert abs(tails[1] - tails[0]) < 0.07


def test_labels_of_one_class_reject_nothing(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(30)], "doc_id long, text string")
    for toxic in (0, 1):
        model = fit_toxicity(docs, spark.createDataFrame([(k, toxic) for k in range(30)], "doc_id long, toxic int"))
        assert model.base == toxic and drop_toxic(docs, model).count() == 30
        assert {r.score for r in score(docs, model).collect()} == {float(toxic)}
