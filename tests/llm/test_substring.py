import random

import pytest

from tidemark.llm.substring import digest, digest_by_hand

SCHEMA = "doc_id long, text string, lang string, did string"


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(i, t, "en", "x") for i, t in rows], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in digest(df).collect())


def corpus(seed, n=60):
    rnd = random.Random(seed)
    vocabulary = ["a", "bé", "cc", "　d", "e.e", "X", "x"]
    passage = [rnd.choice(vocabulary) for _ in range(55)]
    out = []
    for i in range(n):
        words = [rnd.choice(vocabulary) for _ in range(rnd.choice([0, 3, 19, 20, 21, 150]))]
        if rnd.random() < 0.5:
            at = rnd.randrange(len(words) + 1)
            words[at:at] = passage[rnd.randrange(20) :]
        if rnd.random() < 0.2:
            words = ["go"] * rnd.randrange(60)
        out.append((i * 3, rnd.choice([" ", "\n", "\t ", "\x0b"]).join(words)))
    out += [(1000, None), (1001, ""), (1002, out[3][1]), (1, out[40][1])]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    wanted = digest_by_hand(rows)
    assert run(spark, rows) == sorted((i, *r) for i, r in wanted.items())


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(str(i % 97) for i in range(97)) + " end"
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (7, "short"), (7, "other")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in digest(df).collect()), key=str)
    assert got == sorted([(5, 98, 98), (5, 98, 98), (None, 98, 0), (7, 1, 0), (7, 1, 0)], key=str)


def test_empty_table_and_long_text(spark):
    assert digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = " ".join(f"w{i}" for i in range(30_000))
    df = spark.createDataFrame([(1, long), (2, "x " + long)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in digest(df).collect()) == [(1, 0), (2, 30_000)]
