"""What the corpus operators share: shared storage, ids of documents, bounded memory of words."""

from __future__ import annotations

import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset on a single machine (tests), a folder of our own; on a
    cluster, whose machines do not share their temporary folders, that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="loomlog-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below the folder of this application."""
    return f"{shared_dir(spark)}/loomlog/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df once as Parquet to the shared folder and read it back: lineage is cut and lost executors cost nothing."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hot_keys(counted: DataFrame, key: str, size: str, total: int, share: int = 1000, least: int = 1000) -> DataFrame | None:
    """The keys that more than a thousandth of all rows, and more than `least` rows, have, from counted (one row per key,
    `size` rows each; `total` in all); None where there can be none. There are fewer than `share` of them, whatever the
    data, so they may be broadcast."""
    return counted.where(F.col(size) > max(total / share, least)).select(key) if total > least else None


def join_dealt(many: DataFrame, few: DataFrame, key: str, hot: DataFrame | None, spread: list[str], how: str = "inner", salts: int = 64) -> DataFrame:
    """many.join(few, key, how), where no task gets all rows of a hot key: those of many are dealt over `salts` by the
    columns `spread`, and those of few are repeated for each. hot: see hot_keys. Keys are never null."""
    if hot is None:
        return many.join(few, key, how)
    hot = F.broadcast(hot.select(key, F.lit(True).alias("__hot")))
    dealt = many.join(hot, key, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*spread), F.lit(salts))).otherwise(0).cast("int")).drop("__hot")
    each = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(few.join(hot, key, "left").withColumn("__salt", F.explode(each)).drop("__hot"), [key, "__salt"], how).drop("__salt")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text leaves 1 when divided by 3; a null id is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def is_held_out(doc_id) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 3 == 1


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. Texts without other letters take the fast built-in path."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


class Memo(dict):
    """word -> value, computed once per Python worker; emptied when it holds `limit` words, so memory stays bounded.
    Words of more than 256 characters are computed each time."""

    def __init__(self, compute, limit: int = 1 << 17):
        self.compute, self.limit = compute, limit

    def __missing__(self, word):
        value = self.compute(word)
        if len(word) <= 256:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value


def drop_tables(spark: SparkSession) -> None:
    """Delete the tables that operators of this application have written to the shared folder; other jobs keep theirs. For
    when results have been written: what is still to be computed may read these tables."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/loomlog/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
