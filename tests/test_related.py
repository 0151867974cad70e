"""Clusters of terms that contain one another, against a plain union of all pairs."""

import random

from pyspark.sql import functions as F

from tidemark.operators import related


def plain(terms):
    """term -> key of the longest term of its cluster."""
    keys = {" ".join(t.split()).lower() for t in terms if t and t.strip()}
    cjk = lambda k: any("぀" <= c <= "ヿ" or "一" <= c <= "鿿" for c in k)
    inside = lambda a, b: a != b and (a in b if cjk(a) else f" {a} " in f" {b} ")
    cluster = {k: {k} for k in keys}
    for a in keys:
        for b in keys:
            if inside(a, b) and cluster[a] is not cluster[b]:
                both = cluster[a] | cluster[b]
                for k in both:
                    cluster[k] = both
    return {k: min(cluster[k], key=lambda x: (-len(x), x)) for k in keys}


def test_terms_in_order(spark):
    terms = ["Iron Man", "man", "Iron  man suit", "Suit", "manual", "東京", "東京タワー", "タワー", "alone", "man", None, " ", "Ironman"]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, id int")
    got = related.related_terms(df)
    assert {r.key: r.cluster for r in got.collect()} == plain(terms)
    assert got.where("term = 'man'").count() == 2
    order = [r.key for r in got.orderBy("cluster", F.desc("units"), "key").collect()]
    assert order == ["alone", "iron man suit", "iron man", "suit", "man", "man", "ironman", "manual", "東京タワー", "タワー", "東京"]
    assert related.related_terms(df.where("false")).count() == 0


def test_random_terms_and_long_chains(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    terms = [" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(150)]
    terms += [x for i in range(40) for x in (f"c{i}", f"c{i} c{i + 1}")]
    got = related.related_terms(spark.createDataFrame([(t,) for t in terms], "term string"))
    assert {r.key: r.cluster for r in got.collect()} == plain(terms)
