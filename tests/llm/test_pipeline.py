"""The pipeline against a plain version of each stage over the smallest tables."""

import os

import public_tokenizers
import pytest
import sentencepiece

from test_exact_dedup import LOWER
from test_ngram_join import brute

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not there")
def test_pipeline_equals_plain_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, SF)
    assert clean.schema == docs.schema
    rows = {r.doc_id: r.text for r in clean.collect()}
    winners = {}
    for i, t in rows.items():
        norm = t.translate(LOWER)
        winners[norm] = max(i, winners.get(norm, i))
    rows = {i: rows[i] for i in winners.values()}
    rows = {i: rows[i] for i, (_, c) in brute(sorted(rows.items())).items() if i == c}
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {i: t for i, t in rows.items() if not any(x in " ".join(t.lower().split()) for x in items)}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {i: sp.encode(t) for i, t in rows.items()}


def test_odd_and_empty_tables(spark, odd_docs, no_docs, tmp_path):
    """Nulls, blank, repeated and very long texts, clashing columns, no labels of a second class; and no documents at all."""
    import corpus_pipeline

    labels = spark.createDataFrame([(k, 1, 0) for k in range(4)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "ONE two  three four five six"), (2, None)], "item_id long, text string")
    for name, docs, want in (("odd", odd_docs, {1, 2, 3, 5, 7, 9, 10}), ("none", no_docs, set())):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        bench.write.parquet(f"{folder}/benchmark.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, run in corpus_pipeline.STAGES[:-1]:
            now = run(spark, now, folder)
            assert now.schema == docs.schema, stage
        rows = corpus_pipeline.run(spark, folder).collect()
        assert {r.doc_id for r in rows} == want and len(rows) == len(want)
