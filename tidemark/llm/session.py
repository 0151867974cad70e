"""Where intermediate tables go, and small helpers that several operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII blanks that separate words: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
NO_ID = -(2**63)
#: Bytes of an Arrow batch.
BATCH_BYTES = 1 << 22
#: Keys that count as hot have more rows than the first; and there are at most as many of them as the second.
LEAST_HOT, HOT_KEYS = 1000, 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. A session that names none gets one of
    its own only in local mode, where driver and executors are one process; elsewhere that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stash(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    The lineage ends there, so a lost executor costs only the tasks that were running, and a table that is
    used twice is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def release(table: DataFrame) -> None:
    """Delete a stashed table that nothing reads any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.stashed_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_unique(left: DataFrame, right: DataFrame, key: str, weight: str) -> DataFrame:
    """left with the columns of right, which has each key once; rows of left without one get nulls.

    weight (a column of right) says how many rows left has with that key. Keys with so many that one task would have
    far more than the others are at most HOT_KEYS; they are broadcast, and the rest is shuffled. Both sides are read
    twice, so they should be stashed.
    """
    total, most = right.agg(F.sum(weight), F.max(weight)).first()
    bound = max(LEAST_HOT, (total or 0) // HOT_KEYS)
    if (most or 0) <= bound:
        return left.join(right, key, "left")
    hot = right.where(F.col(weight) > bound)
    aside = left.join(F.broadcast(hot), key)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return aside.unionByName(rest.join(right.where(F.col(weight) <= bound), key, "left"))


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold at most BATCH_BYTES, for the rest of the session: texts and packed rows are long, and a
    batch is held more than once on its way to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed(docs: DataFrame, hashed: bool = True) -> DataFrame:
    """(did, th, text): did is doc_id with null as the least long; th, a hash of the text, tells texts of one doc_id
    apart. Without hashed, th is 0 where every doc_id stands once, as rows sort and compress better then.

    Rows with equal doc_id and text are one document wherever documents are compared.
    """
    small_batches(docs.sparkSession)
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did")
    text = F.coalesce(F.col("text"), F.lit(""))
    hashed = hashed or not docs.select(did).groupBy("did").count().where("count > 1").isEmpty()
    return docs.select(did, (F.xxhash64(text) if hashed else F.lit(0).cast("long")).alias("th"), text.alias("text"))


def doc_id_of(did: str | Column) -> Column:
    """The doc_id that did stands for."""
    column = F.col(did) if isinstance(did, str) else did
    return F.when(column != NO_ID, column)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bytes_estimate(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
