"""Very long texts full of what the operators look for: whole results, in a time that grows with the length."""

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from loomlog.llm.decontamination import drop_contaminated, find_leaks
from loomlog.llm.exact_dedup import deduplicate, exact_groups
from loomlog.llm.language_id import LanguageModel, Lattice, identify
from loomlog.llm.ngram_join import near_duplicates
from loomlog.llm.pii_surrogates import pseudonymise
from loomlog.llm.quality_ordinal import BUCKETS as CELLS
from loomlog.llm.quality_ordinal import OrdinalModel, rate
from loomlog.llm.secrets import scan
from loomlog.llm.sentencepiece_bpe import encode
from loomlog.llm.token_counts import count_tokens
from loomlog.llm.toxicity_crf import BUCKETS, ToxicityModel, drop_toxic, score

N = 8_000
PART = "Mr. John Smith wrote to a.b@mail.example.com, +1 415 555 0123: token=abcdefgh{k} you bad moron, it is so.\n"
TEXTS = ["".join(PART.format(k=k) for k in range(N)), "".join(PART.format(k=k) for k in range(N + 50)), "bad " * 200_000, "é" * 300_000, None]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3).persist()


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_pii(docs):
    rows = by_id(pseudonymise(docs, "key"))
    assert rows[0].n_entities == 3 * N and rows[2].text == TEXTS[2] and rows[4].text is None
    assert "Smith" not in rows[0].text and "555 0123" not in rows[0].text and rows[0].text.count("token=") == N
    assert rows[1].text.startswith(rows[0].text)
    spans = [TEXTS[0][e.start : e.end] for e in rows[0].entities[-3:]]
    assert spans == ["Mr. John Smith", "a.b@mail.example.com", "+1 415 555 0123"]


def test_exact_dedup(docs):
    assert all(r.kept and r.group_size == 1 for r in exact_groups(docs).collect()) and deduplicate(docs).count() == 5


def test_sentencepiece_and_counts(docs):
    path, words = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
    sp, tk = sentencepiece.SentencePieceProcessor(model_file=path), tokenizers.Tokenizer.from_file(words)
    coded, counted = by_id(encode(docs, path)), by_id(count_tokens(docs, words))
    for k in (1, 2):
        assert list(coded[k].ids) == sp.encode(TEXTS[k]) and coded[k].decoded == sp.decode(sp.encode(TEXTS[k]))
        assert counted[k].n_tokens == len(tk.encode(TEXTS[k], add_special_tokens=False).ids)


def test_secrets(docs):
    rows = by_id(scan(docs))
    assert rows[0].n_assign == N and len(rows[0].found) == N and rows[2].n_assign == rows[3].n_assign == rows[4].n_assign == 0
    last = rows[0].found[-1]
    assert TEXTS[0][last.start : last.end] == f"token=abcdefgh{N - 1}"


def test_ngram_join(docs):
    rows = by_id(near_duplicates(docs))
    assert rows[1].component_id == 0 and rows[2].n_shingles == 1 and rows[3].component_id == 3 and rows[4].n_shingles == 0


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(1, "token=abcdefgh77 you bad moron, it is so."), (2, "nowhere to be found at all")], "item_id long, text string")
    rows = by_id(find_leaks(docs, bench))
    assert rows[0].contaminated and not rows[2].contaminated and {x.item_id for x in rows[0].leaks} == {1}
    assert any(x.edits == 0 and TEXTS[0][x.start : x.end] == "token=abcdefgh77 you bad moron, it is so." for x in rows[0].leaks)
    assert {r.doc_id for r in drop_contaminated(docs, bench).collect()} == {2, 3, 4}


def test_classifiers(docs):
    lat = Lattice(public_tokenizers.path("piece_bpe_32k.model"))
    rows = by_id(identify(docs, LanguageModel(["x", "y"], np.random.default_rng(1).random((lat.size, 2)) / 100, public_tokenizers.path("piece_bpe_32k.model"))))
    assert {rows[k].lang_pred for k in (0, 1, 2, 3)} <= {"x", "y"} and rows[4].lang_pred == "und"
    weights = np.zeros(2 * BUCKETS + 2)
    weights[0], weights[-1] = 9.0, -5.0
    model = ToxicityModel({"bad": 0}, weights, np.ones((2, 2)), np.array([-2.0, 1.0, 0.5]))
    rows = by_id(score(docs, model))
    assert len(rows[0].spans) == N and len(rows[2].spans) == 200_000 and rows[3].predicted == 0 and rows[2].predicted == 1
    assert TEXTS[0][rows[0].spans[-1].start : rows[0].spans[-1].end] == "bad"
    assert {r.doc_id for r in drop_toxic(docs, model).collect()} == {3, 4}
    rows = by_id(rate(docs, OrdinalModel([0, 1, 2], np.ones(CELLS), np.array([1.0, 4.0]))))
    assert abs(rows[0].tail_probability - rows[2].tail_probability) < 1e-9 and rows[4].tail_probability < 0.5
