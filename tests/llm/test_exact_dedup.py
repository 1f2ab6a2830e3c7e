import hashlib
import os
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomlog.llm import common
from loomlog.llm.exact_dedup import deduplicate, exact_groups

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r.text or "").translate(LOWER)].append(r.doc_id)
    out = []
    for norm, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i in ids]
    return Counter(out)


def test_equals_brute_force(odd_docs):
    assert Counter(map(tuple, exact_groups(odd_docs.repartition(5)).collect())) == brute(odd_docs.collect())


def test_colliding_digests_do_not_merge(odd_docs):
    weak = lambda sha: F.substring(sha, 1, 0)  # noqa: E731  every digest collides
    assert Counter(map(tuple, exact_groups(odd_docs, digest=weak).collect())) == brute(odd_docs.collect())
    kept = Counter(r.doc_id for r in deduplicate(odd_docs, digest=weak).collect())
    assert kept == Counter(r.doc_id for r in deduplicate(odd_docs).collect())


def test_deduplicate_keeps_columns_and_one_of_each(odd_docs, no_docs):
    kept = deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids) == sorted([2, 3, 5, 7, 9, 10, 12, 1]) and deduplicate(no_docs).count() == 0 == exact_groups(no_docs).count()


def test_a_hot_group_over_many_partitions(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("Hot text")).otherwise(F.concat(F.lit("t"), F.col("id") % 500)).alias("text")).repartition(16)
    rows = exact_groups(docs, salts=4).where("group_size > 100").distinct().collect()
    assert {(r.keep_id, r.group_size) for r in rows} == {(2999, 2000)} and len(rows) == 2000


def test_tables_can_be_dropped(spark, odd_docs):
    kept = common.materialize(odd_docs, "dropped")
    path = kept.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    common.drop_tables(spark)
    assert not os.path.exists(path)


def test_a_folder_of_our_own_is_for_single_machines():
    class Conf(dict):
        get = dict.get

        def set(self, key, value):
            self[key] = value

    class Session:
        conf = Conf({"spark.master": "yarn"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
    Session.conf = Conf({"spark.master": "local[2]"})
    assert common.shared_dir(Session()) == Session.conf["spark.checkpoint.dir"]
