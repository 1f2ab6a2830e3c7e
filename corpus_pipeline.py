"""From raw documents to token ids: toxic documents go, then exact copies, near copies and benchmark leaks; the rest is encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomlog.llm.common import documents, materialize
from loomlog.llm.decontamination import drop_contaminated
from loomlog.llm.exact_dedup import deduplicate
from loomlog.llm.ngram_join import keep_one
from loomlog.llm.queries import tokenizer_path
from loomlog.llm.sentencepiece_bpe import encode
from loomlog.llm.toxicity_crf import drop_toxic, fit_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learned from the labelled ones among them, finds toxic go."""
    return drop_toxic(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    return deduplicate(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, exact or with few edits, go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and the text they decode to."""
    return encode(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: Learned models, components and byte-pair encoding are not SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
