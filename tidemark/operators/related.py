"""Terms that contain one another, in clusters.

A term is contained in another if it stands there word by word; one with Han or kana also within a word. Terms are compared
in lower case with single blanks. Containment is found by the grams of the longer term, not by comparing all with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.files import shared_folder

UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"
BLANKS = r"(?U)\s+"


def folded(term: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(term, BLANKS, " ")))


def _grams(items: Column, longest: Column | int, separator: str) -> Column:
    """All runs of up to `longest` items, joined."""
    n = F.size(items)
    runs = lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(items, i, k), separator))
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.least(n, F.lit(longest))), runs)))


def contained(keys: DataFrame) -> DataFrame:
    """inner, outer of different keys (key, each once, not empty). Grams are no longer than the longest key that can stand
    inside another."""
    unspaced = F.col("key").rlike(UNSPACED)
    sizes = keys.agg(F.max(F.size(F.split("key", " "))).alias("words"), F.coalesce(F.max(F.when(unspaced, F.length("key"))), F.lit(0)).alias("chars")).first()
    words = keys.select(F.col("key").alias("outer"), F.explode(_grams(F.split("key", " "), sizes["words"] or 1, " ")).alias("key"))
    found = words.where("key <> outer")
    if sizes["chars"]:
        chars = keys.where(unspaced).select(F.col("key").alias("outer"), F.explode(_grams(F.split("key", ""), sizes["chars"], "")).alias("key"))
        found = found.union(chars.where(F.col("key").rlike(UNSPACED) & (F.col("key") != F.col("outer")))).distinct()
    return found.join(keys, "key").select(F.col("key").alias("inner"), "outer")


def roots(pairs: DataFrame) -> DataFrame:
    """node, root (the least of its component) of the nodes of pairs (a, b).

    Stars in turn: each node hands its greater neighbours, then its smaller ones, to the least one it knows; the number of
    rounds grows with the logarithm of the longest path. A node with many neighbours is only aggregated and joined. Each
    round is a table in the shared folder.
    """
    spark, folder = pairs.sparkSession, shared_folder(pairs.sparkSession)

    def write(edges: DataFrame, number: int) -> tuple[DataFrame, tuple]:
        path = f"{folder}/round={number}"
        edges.write.parquet(path)
        table = spark.read.schema(edges.schema).parquet(path)
        # The sum of hashes tells whether a round has changed anything; it is exact up to equal sums by chance.
        return table, tuple(table.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())

    def handed(edges: DataFrame, whole: bool) -> DataFrame:
        """Edges (u > v) after one half of a round: greater neighbours of each node (whole), or smaller ones and itself."""
        seen = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if whole else edges
        least = seen.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m") if whole else F.min("v").alias("m"))
        moved = seen.join(least, "u").where("v > u" if whole else "v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.distinct() if whole else moved.union(least.select("u", F.col("m").alias("v"))).distinct()

    start = pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = write(start, 0)
    number = 0
    while True:
        number += 1
        edges, after = write(handed(handed(edges, True), False), number)
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        before = after


def related_terms(terms: DataFrame) -> DataFrame:
    """terms (with term) with key, cluster and units: the key of the longest term of the cluster, and the term's length in
    UTF-16 units. Sorted by cluster, units downward and key, related terms stand together, the longest first. Null and
    blank terms are left out; repeated ones are kept."""
    rows = terms.withColumn("key", folded(F.col("term"))).where("key <> ''").withColumn("units", F.length(F.encode("key", "UTF-16BE")) / 2)
    keys = rows.select("key", "units").distinct()
    found = roots(contained(keys.select("key")).select(F.col("inner").alias("a"), F.col("outer").alias("b")))
    labelled = keys.join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    first = labelled.groupBy("root").agg(F.min(F.struct(-F.col("units"), F.col("key").alias("k")))["k"].alias("cluster"))
    return rows.join(labelled.join(first, "root").select("key", "cluster"), "key").withColumn("units", F.col("units").cast("int"))
