"""Terms of a glossary in texts: both ways against all places of a text, and what is shuffled."""

import random
import re

from tidemark.operators import cues as C


def hits(docs, terms, most=None):
    """By looking at every place of every text."""
    out = {}
    keys = {t.lower(): t for t in terms if t is not None}
    most = most or max(len(t.split(" ")) for t in keys)
    for i, text in docs:
        words = re.findall(r"[^\W_]+(?:'[^\W_]*)*|'+[^\W_]*", (text or "").lower())
        for k in range(len(words)):
            for n in range(1, most + 1):
                key = " ".join(words[k : k + n])
                if k + n <= len(words) and key in keys:
                    out[i, keys[key]] = out.get((i, keys[key]), 0) + 1
    return out


def some(spark):
    rnd = random.Random(8)
    docs = [(i, " ".join(rnd.choice(["the", "The", "of", "in", "one", "der", "x,", "é", "of the."]) for _ in range(rnd.randrange(40)))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, "of the"), (63, "the"), (64, "...")]
    terms = ["the", "Of the", "one of the", "in der", "é", "of  the", "", "of ", " the", "x", "absent term of four", None]
    return docs, terms, spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame([(t,) for t in terms], "term string")


def test_both_ways_against_all_places(spark):
    docs, terms, a, b = some(spark)
    for most in (None, 1, 2):
        wanted = hits(docs, terms, most)
        assert wanted
        for size in (C.BROADCAST_BYTES, 0):
            got = {(r.doc_id, r.term): r.n for r in C.glossary_hits(a, b, most, size).collect()}
            assert got == wanted, (most, size)


def test_grams_are_not_shuffled(spark):
    """A small glossary goes to the texts. Of a large one's shuffle, grams that no term has are left out."""
    docs, terms, a, b = some(spark)
    joins = lambda found: re.findall(r"Join (?:Inner|LeftSemi),.*", found._jdf.queryExecution().optimizedPlan().toString())
    small, large = joins(C.glossary_hits(a, b)), joins(C.glossary_hits(a, b, broadcast_bytes=0))
    assert len(small) == 2 and all("strategy=broadcast" in x for x in small)
    assert sorted("strategy=broadcast" in x for x in large) == [False, True]
    rows = spark.createDataFrame([(f"word {i}",) for i in range(20_000)], "key string")
    few = rows.where("key like '%7777'")
    left = {r.key for r in C.in_bitmap(rows, few, "key").collect()}
    assert {"word 7777", "word 17777"} <= left and len(left) < 10
    assert C.in_bitmap(rows, rows, "key").count() == 20_000
