"""Audit of how filters interact, by aggregation over the edges of the lattice of filter subsets.

Five filters can be applied in 120 orders of 5 steps. What a filter does at a step depends only on which filters came
before, not on their order: a step is an edge (subset already applied, next filter) of the lattice of subsets, and there
are 80. Each document contributes to all 80 edges; documents with the same failures and labels do so together, as they
are counted before they are spread over the edges. An order is a path of 5 edges through the lattice, so the 600 steps are
a join with the aggregated edges. A filter's Shapley sum weighs each of its edges by the number of paths through it.

The shuffles carry a row of ids and digests for each document (for equal texts and for labels), never texts; after that
only counts are left: at most 128 rows of failures and labels for each part and task.

Defined results: null text is empty and fails A alone of the first four; texts are equal if their SHA-256 digests are; a
null doc_id neither is smaller than another nor has a smaller one; rows repeated with one doc_id don't fail E for each
other and count once each; a null source and an empty one are one part; of several labels of a doc_id any that is 1
counts; labels without a document count nowhere; very long texts are one row's work; an empty table gives an empty one;
further columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quality import let, words_of
from .session import join_unique, stash

FILTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def lattice_edges() -> list[tuple[int, str]]:
    """(subset already applied as bits, next filter): 80 edges."""
    return [(s, f) for s in range(1 << len(FILTERS)) for f in FILTERS if not s & BIT[f]]


def lattice_paths(spark: SparkSession) -> DataFrame:
    """applied, filter, filter_order, step: the edge of each of the 600 steps."""
    rows = [(sum(BIT[x] for x in order[:i]), f, "".join(order), i + 1) for order in permutations(FILTERS) for i, f in enumerate(order)]
    return spark.createDataFrame(rows, "applied int, filter string, filter_order string, step int")


def own_failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest, own: the bits of the filters A to D that the text fails by itself."""

    def bits(words, text):
        n = F.size(words)
        failed = {
            "A": n < 200,
            "B": F.lit(100).cast("long") * F.size(F.array_distinct(words)) < F.lit(50).cast("long") * n,
            "C": F.lit(100).cast("long") * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > F.lit(2).cast("long") * F.length(text),
            "D": text.rlike(r"[#$%&*|]"),
        }
        return sum((F.when(c, BIT[f]).otherwise(0) for f, c in failed.items()), F.lit(0))

    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        let(words_of(text), lambda w: bits(w, text)).alias("own"),
    )


def patterns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, failed (bits of all five filters), good, toxic, n: documents by what they fail and how they are labelled."""
    facts = stash(own_failures(docs))
    shared = stash(facts.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1"))
    marked = join_unique(facts, shared, "digest", "n")
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    told = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    failed = (F.col("own") + F.when(copy, BIT["E"]).otherwise(0)).alias("failed")
    of_label = [F.coalesce(F.col(x), F.lit(False)).alias(x) for x in ("good", "toxic")]
    return marked.select("doc_id", "part", failed).join(told, "doc_id", "left").groupBy("part", "failed", *of_label).agg(F.count("*").alias("n"))


def edge_counts(counted: DataFrame) -> DataFrame:
    """part, applied, filter and the counts of the edge, with shapley: its filter's removals over all orders."""
    edges = F.array(*(F.struct(F.lit(s).alias("applied"), F.lit(f).alias("filter"), F.lit(BIT[f]).alias("bit"), F.lit(factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count())).alias("paths")) for s, f in lattice_edges()))
    spread = counted.withColumn("edge", F.explode(edges)).select("part", "failed", "good", "toxic", "n", "edge.*")
    there, fails = F.col("failed").bitwiseAND(F.col("applied")) == 0, F.col("failed").bitwiseAND(F.col("bit")) != 0
    of = {
        "kept": there & ~fails,
        "removed": there & fails,
        "redundant": ~there & fails,
        "unique_fails": F.col("failed") == F.col("bit"),
        "good_lost": there & fails & F.col("good"),
        "toxic_lost": there & fails & F.col("toxic"),
    }
    summed = spread.groupBy("part", "applied", "filter", "paths").agg(*(F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name) for name, c in of.items()))
    return summed.withColumn("shapley", F.sum(F.col("removed") * F.col("paths")).over(W.partitionBy("part", "filter"))).drop("paths")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows a part."""
    edges = edge_counts(patterns(docs, labels))
    paths = F.broadcast(lattice_paths(docs.sparkSession))  # 600 rows
    return edges.join(paths, ["applied", "filter"]).select("part", "filter_order", "step", *COUNTS, "shapley")


#: Walks every order step by step instead of the lattice.
ORACLE_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\x0c\r]+'), lambda w: w <> '') AS words FROM documents),
failing AS (SELECT doc_id, part, CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS failed FROM texts),
told AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
counted AS (SELECT part, failed, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM failing LEFT JOIN told ON failing.doc_id = told.doc_id GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, step::INTEGER AS step, substr(filter_order, step, 1) AS filter, substr(filter_order, 1, step - 1) AS applied FROM orders, (SELECT unnest(range(1, 6)) AS step)),
met AS (SELECT part, filter_order, step, filter, n, good, toxic, failed = filter AS alone, contains(failed, filter) AS fails, translate(applied, failed, '') = applied AS there FROM counted, steps),
summed AS (SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (there AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (there AND fails), 0) AS removed,
  coalesce(sum(n) FILTER (NOT there AND fails), 0) AS redundant, coalesce(sum(n) FILTER (alone), 0) AS unique_fails,
  coalesce(sum(n) FILTER (there AND fails AND good), 0) AS good_lost, coalesce(sum(n) FILTER (there AND fails AND toxic), 0) AS toxic_lost FROM met GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM summed
"""
