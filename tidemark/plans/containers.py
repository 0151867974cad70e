"""Registered queries on container files, which Spark writes from the given tables and reads again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import query, table
from tidemark.sources import matroska
from tidemark.sources.files import shared_folder

#: A track for each role, one of each compression; the rest has a track of its own.
TRACKS = [
    {"number": 1, "name": "user", "language": "eng"},
    {"number": 2, "name": "assistant", "compression": "zlib"},
    {"number": 3, "name": "other", "compression": "header", "prefix": "- "},
]
SPOKEN = "spoken AS (SELECT conv_id, turn, CASE WHEN role IN ('user', 'assistant') THEN role ELSE 'other' END AS name, CASE WHEN role IN ('user', 'assistant') THEN text ELSE '- ' || text END AS text, CASE WHEN turn % 3 <> 0 THEN 50 * length(text) END AS duration_ms FROM conversations WHERE text <> '')"


def film(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(blocks, tracks) of the conversations written as Matroska files: each has a million milliseconds, a turn four
    thousand of them."""
    role = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(3)
    said = table(spark, sf_dir, "conversations").select(
        role.alias("track"),
        (F.col("conv_id").cast("long") * 1_000_000 + F.col("turn") * 4000).alias("start_ms"),
        F.when(F.col("turn") % 3 != 0, 50 * F.length("text")).alias("duration_ms"),
        F.when(role == 3, F.concat(F.lit("- "), F.nullif("text", F.lit("")))).otherwise(F.col("text")).alias("text"),
    )
    folder = shared_folder(spark)
    matroska.write(said, folder, TRACKS)
    return matroska.read(spark, folder)


@query(f"WITH {SPOKEN} SELECT conv_id, turn, name, duration_ms, md5(text) AS digest FROM spoken")
def matroska_blocks(spark, sf_dir):
    blocks, tracks = film(spark, sf_dir)
    texts = matroska.decode(blocks, tracks).join(F.broadcast(names(spark)), "track")
    return texts.select(F.floor(F.col("start_ms") / 1_000_000).alias("conv_id"), F.floor(F.col("start_ms") % 1_000_000 / 4000).alias("turn"), "name", "duration_ms", F.md5("text").alias("digest"))


def names(spark: SparkSession) -> DataFrame:
    """The three tracks by name: a table of fixed size."""
    return spark.createDataFrame([(t["number"], t["name"]) for t in TRACKS], "track long, name string")


@query(f"WITH {SPOKEN} SELECT name, count(*) AS frames FROM spoken GROUP BY 1")
def matroska_frames(spark, sf_dir):
    """The numbers of blocks that the files declare, by the names of their tracks."""
    _, tracks = film(spark, sf_dir)
    return tracks.groupBy("name").agg(F.sum("frames").alias("frames")).where("frames > 0")
