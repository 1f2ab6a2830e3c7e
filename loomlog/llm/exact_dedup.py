"""Exact deduplication in three merges that skewed groups of copies cannot overload.

1. local: the map side of the first aggregate keeps one row per (digest, content) and task;
2. salted: those local winners meet by (digest, salt), the salt being the task they come from, so a group with a
   third of all rows is dealt over `salts` reducers;
3. global: at most `salts` winners per content meet by digest.

Every merge groups by the normalised content beside the digest, so two contents with one digest never merge. The rows
get their winner back by digest where the digest was seen with one content (equal digests are then known to be equal
contents), and by content where a digest has several. That second table is empty unless the digest collides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, join_dealt, lower_ascii, materialize


def _merged(docs: DataFrame, text: str, key: str, salts: int, digest):
    """Rows with their digests; contents with their winners (a lazy table); winners by digest (written); digests that very
    many rows have."""
    norm = lower_ascii(F.coalesce(docs[text], F.lit("")))
    rows = docs.select(docs[key].alias("doc_id"), norm.alias("norm")).withColumn("digest", digest(F.unhex(F.sha2(F.col("norm"), 256))))
    local = rows.select("doc_id", "norm", "digest", (F.spark_partition_id() % salts).alias("salt"))
    salted = local.groupBy("digest", "norm", "salt").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    contents = (
        salted.repartition("digest")
        .groupBy("digest", "norm")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    )
    winners = materialize(
        contents.groupBy("digest").agg(
            F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.sum("group_size").alias("rows"), F.count(F.lit(1)).alias("contents")
        ),
        "winners",
    )
    total = winners.agg(F.sum("rows")).first()[0] or 0
    return rows, contents, winners, hot_keys(winners, "digest", "rows", total)


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", salts: int = 32, digest=None) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id (largest key among equal texts), group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, so null and empty texts form one group.
    Rows that repeat a key are each counted and each returned. A null key is never kept while its group has another key.
    An empty table gives an empty result; other columns of docs are ignored, whatever their names. Texts of any length are
    compared whole; after the merges only ids and digests move. `digest` maps the SHA-256 of the text to the value that
    is merged on, by default itself; a weaker one only costs time, never correctness.
    """
    rows, contents, winners, hot = _merged(docs, text, key, salts, digest or (lambda sha: sha))
    sha = F.sha2("norm", 256) if digest else F.lower(F.hex("digest"))
    some = rows.select("doc_id", "digest", sha.alias("text_sha256")) if digest else rows.select("doc_id", "digest")
    found = join_dealt(some, winners.where("contents = 1").select("digest", "keep_id", "group_size"), "digest", hot, ["doc_id"])
    if not digest:
        found = found.withColumn("text_sha256", sha)
    found = found.select("doc_id", "keep_id", "group_size", "text_sha256")
    if not winners.where("contents > 1").isEmpty():
        several = contents.join(winners.where("contents > 1").select("digest"), "digest", "left_semi")
        by_content = rows.join(several, ["digest", "norm"]).select("doc_id", "keep_id", "group_size", F.sha2("norm", 256).alias("text_sha256"))
        found = found.unionByName(by_content)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", salts: int = 32, digest=None) -> DataFrame:
    """The rows of docs that stay, with all their columns; for nulls, empty and long texts see exact_groups. Where rows
    repeat a kept key with equal text, all of them stay; a winner is met by those rows alone, so no key is hot here."""
    digest = digest or (lambda sha: sha)
    rows, contents, winners, _ = _merged(docs, text, key, salts, digest)
    sha = F.unhex(F.sha2(lower_ascii(F.coalesce(docs[text], F.lit(""))), 256))
    stay = winners.where("contents = 1").select(F.col("digest").alias("digest"), F.col("keep_id").alias("keep_id"))
    if not winners.where("contents > 1").isEmpty():
        several = contents.join(winners.where("contents > 1").select("digest"), "digest", "left_semi")
        stay = stay.unionByName(several.select("digest", "keep_id"))
    return docs.join(stay, (digest(sha) == stay["digest"]) & docs[key].eqNullSafe(stay["keep_id"]), "left_semi")
