import hashlib

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from loomlog.llm.sentencepiece_bpe import encode, encoder
from loomlog.llm.token_counts import count_tokens, counter

MODEL, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = [*"aeiou rst  lnéèßÄ'\n\t\r!?1290_-#$▁▁ <|>", "\x00", "\x1c", "\x85", "\xa0", "　", "Σ", "İ", "́", "ﬁ", "한", "😀", "<|endoftext|>", "<s>", "'s", "'ll", "​", "ǆ", "tion", "the "]


@pytest.fixture
def texts(rng):
    return ["", " ", "<|startoftext|>", *("".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 60))) for _ in range(3000)), "a" * 3000, "aaab" * 800, "▁" * 500]


def test_sentencepiece_is_the_librarys(texts):
    sp, ours = sentencepiece.SentencePieceProcessor(model_file=MODEL), encoder(MODEL)
    for t in texts:
        ids = sp.encode(t)
        assert ours.encode(t) == ids and ours.decode(ids) == sp.decode(ids), t
        assert ours.encode_decode(t) == (",".join(map(str, ids)), len(ids), sp.decode(ids))


def test_search_equals_plain_merging(rng):
    ours = encoder(MODEL)
    for _ in range(500):
        word = "▁" + "".join(rng.choice("aeioustrnl") for _ in range(rng.randint(1, 30)))
        assert ours.search(word) == ours.merge(word)


def test_counts_are_the_librarys(texts):
    library, ours = Tokenizer.from_file(WORDS), counter(WORDS)
    for t in texts:
        assert ours.count(t) == len(library.encode(t, add_special_tokens=False).ids), t


def test_operators_on_odd_tables(odd_docs, no_docs):
    sp, library = sentencepiece.SentencePieceProcessor(model_file=MODEL), Tokenizer.from_file(WORDS)
    source = odd_docs.collect()
    rows = encode(odd_docs, MODEL, digests=True).collect()
    assert len(rows) == len(source)
    for r, s in zip(rows, source):
        ids = sp.encode(s.text or "")
        assert tuple(r) == (s.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    whole = encode(odd_docs, MODEL).collect()
    assert [r.decoded for r in whole] == [s.text or "" for s in source] and [len(r.ids) for r in whole] == [r.n_tokens for r in rows]
    counted = count_tokens(odd_docs, WORDS, limit=3).collect()
    for r, s in zip(counted, source):
        n = len(library.encode(s.text or "", add_special_tokens=False).ids)
        assert tuple(r) == (s.doc_id, len((s.text or "").encode()), n, n > 3)
    assert encode(no_docs, MODEL).count() == 0 == count_tokens(no_docs, WORDS).count()


def test_sentencepiece_words_of_a_large_text_are_searched_once(monkeypatch):
    """150,000 distinct words, twice: what was found for a word is kept, and is what the library gives."""
    import public_tokenizers
    import sentencepiece

    from loomlog.llm.sentencepiece_bpe import BacktrackingEncoder

    path = public_tokenizers.path("piece_bpe_32k.model")
    enc, library = BacktrackingEncoder(path), sentencepiece.SentencePieceProcessor(model_file=path)
    searched, search = [], enc.encode_unit
    monkeypatch.setattr(enc, "encode_unit", lambda unit: searched.append(1) or search(unit))
    text = " ".join(f"{'tionanerth'[k % 7 :]}{k:x}" for k in range(150_000))
    ids, n, decoded = enc.encode_decode(f"{text} {text}")
    assert len(searched) <= 150_000 and decoded == f"{text} {text}"
    expected = library.encode(f"{text} {text}")
    assert n == len(expected) and ids == ",".join(map(str, expected))
