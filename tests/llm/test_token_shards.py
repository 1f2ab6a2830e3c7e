import zlib

import numpy as np
import public_tokenizers
import pytest
from test_tokenizers import ALPHABET
from tokenizers import Tokenizer

from loomlog.llm.token_shards import BitPlane, WaveletMatrix, count_ids, encoder, find_id, ids_at, read_documents, read_shards, write_shards

BYTES = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [0, 1, 7, 511, 512, 513, 5000])
def test_rank_and_select(rng, n):
    bits = np.array([rng.random() < 0.3 for _ in range(n)], dtype=bool)
    plane = BitPlane(np.packbits(bits).tobytes(), n)
    assert plane.rank(np.arange(n + 1)).tolist() == [int(bits[:k].sum()) for k in range(n + 1)]
    assert plane.select(1, np.arange(bits.sum())).tolist() == np.flatnonzero(bits).tolist()
    assert plane.select(0, np.arange(n - bits.sum())).tolist() == np.flatnonzero(~bits).tolist()


@pytest.mark.parametrize("kind, most", [(np.uint16, 0), (np.uint16, 5), (np.uint16, 65535), (np.uint32, 1 << 20)])
def test_matrix(rng, kind, most):
    ids = np.array([min(most, int(rng.expovariate(1 / 40))) if rng.random() < 0.9 else rng.randint(0, most) for _ in range(3000)], dtype=kind)
    m = WaveletMatrix.build(ids)
    again = WaveletMatrix(m.n, m.packed, m.zeros)
    assert again.ids().tolist() == ids.tolist()
    some = np.array([rng.randrange(3000) for _ in range(300)])
    assert again.access(some).tolist() == ids[some].tolist()
    for token in {*ids[:20].tolist(), most, most + 1, 1 << 40, -1}:
        assert again.places(token).tolist() == np.flatnonzero(ids == token).tolist()
        a, b = sorted((rng.randint(0, 3000), rng.randint(0, 3000)))
        assert again.count(token, a, b) == int((ids[a:b] == token).sum()) and again.count(token) == int((ids == token).sum())
    assert WaveletMatrix.build(np.zeros(0, kind)).ids().tolist() == []


def test_ids_are_the_librarys(rng):
    library, ours = Tokenizer.from_file(BYTES), encoder(BYTES)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 60))) for _ in range(4000)]
    texts += ["<|endoftext|>", "a<|endoftext|>b <|endoftext|> <|endoftext", "x" * 20_000, "ab" * 20_000, " " * 20_000 + "x", "\n" * 20_000, "- " * 9000, "é" * 9000, "I'll we'VE 's 't", "a \n\n  b\t\t c   "]
    for t in texts:
        assert ours.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids, t[:80]


@pytest.mark.parametrize("shard_tokens", [1, 100, 1 << 22])
def test_files_hold_the_documents(odd_docs, tmp_path, spark, shard_tokens):
    library, path = Tokenizer.from_file(BYTES), str(tmp_path / "shards")
    write_shards(odd_docs, BYTES, path, shard_tokens=shard_tokens)
    source = [(r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in odd_docs.collect()]
    rows = sorted(read_documents(spark, path).collect(), key=lambda r: r.start)
    assert sorted((str(r.doc_id), r.ids) for r in rows) == sorted((str(k), ids) for k, ids in source)
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda k: (k is not None, k))
    at = 0
    for r in rows:
        assert (r.start, r.n_tokens) == (at, len(r.ids)) and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        at += r.n_tokens
    flat = [i for r in rows for i in r.ids]
    wanted = [2, 50256, 31373, 60000]
    assert {r.token: r.n for r in count_ids(spark, path, wanted).collect()} == {t: flat.count(t) for t in wanted}
    found = sorted((str(r.doc_id), r.place) for r in find_id(spark, path, 31373).collect())
    assert found == sorted((str(r.doc_id), k) for r in rows for k, i in enumerate(r.ids) if i == 31373) and found
    assert sorted((r.doc_id, r.ids) for r in ids_at(spark, path, [4, 8], 1, 5).collect()) == sorted((r.doc_id, r.ids[1:5]) for r in rows if r.doc_id in (4, 8))
    shards = read_shards(spark, path).select("n_tokens", "docs").collect()
    assert all(s.n_tokens == sum(d.n for d in s.docs) and (s.n_tokens <= shard_tokens or len(s.docs) == 1) for s in shards)


def test_no_documents(no_docs, tmp_path, spark):
    path = str(tmp_path / "shards")
    write_shards(no_docs, BYTES, path)
    assert read_documents(spark, path).count() == 0 == find_id(spark, path, 2).count()
