"""Bounded samples of labelled rows for fitting classifiers. Everything but the fit itself covers all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

_GRAIN = 1 << 20


def share(key: str):
    """A fixed number from 0 to 2^20 - 1 for each key."""
    return F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(_GRAIN))


def stratified_ids(labels: DataFrame, label: str, limits: dict | int, key: str = "doc_id") -> tuple[DataFrame, dict]:
    """Ids and labels of about `limits` (a number, or label -> number) rows of each class that may be learned from,
    and label -> weight: how many such rows each sampled one stands for (1 where a class is taken whole).

    Rows with a null id or label and held-out rows are never taken. An id with several labels gives one of them (the
    smallest). The classes themselves must be few: their counts come to the driver.
    """
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key))).select(key, label)
    counts = {r[0]: r[1] for r in usable.groupBy(label).count().collect()}
    condition, weights = F.lit(False), {}
    for value, n in counts.items():
        most = limits if isinstance(limits, int) else limits.get(value, 0)
        taken = int(_GRAIN * min(1.0, most / n))
        weights[value] = _GRAIN / max(taken, 1)
        condition = condition | ((F.col(label) == F.lit(value)) & (share(key) < taken))
    return usable.where(condition).groupBy(key).agg(F.min(label).alias(label)), weights


def labelled_texts(docs: DataFrame, ids: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The texts of a bounded set of ids. The set is bounded by the caller's limits, so it may be broadcast."""
    return docs.select(key, F.coalesce(F.col(text), F.lit("")).alias(text)).join(F.broadcast(ids), key)
