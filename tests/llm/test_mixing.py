import random
from collections import defaultdict

import pytest

from tidemark.llm.mixing import Mix, digest, mix

SCHEMA = "doc_id long, text string, source string, n_chars long, target string, key int"


def rows_of(seed, n=300):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        source = rnd.choice(["a", "a", "a", "a", "B", "é", "zz", None])
        words = rnd.choice([0, 1, 5, 40, 300])
        out.append((i, " ".join(rnd.choice(["x", "yy", "#", "é\n"]) + str(rnd.randrange(50)) for _ in range(words)), source, 7, "t", 1))
    return out + [(None, None, "tiny", None, None, None), (9000, "one two three", "tiny", 1, "t", 2), (9001, "w " * 5000, "big", 1, "t", 2), (9003, "", None, 0, None, None)]


def goals(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    rest, open_, out = share * sum(sizes.values()), set(names), {}
    while True:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: rest * weight[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            rest -= out[s]
            open_.discard(s)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_and_taken(spark, seed):
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    sizes = defaultdict(int)
    for _, text, source, *_ in rows:
        sizes[source] += len((text or "").encode().split())
    wanted = goals(sizes)
    again = sorted(map(str, digest(df.repartition(7)).collect()))
    assert again == sorted(map(str, digest(df).collect()))
    taken = defaultdict(int)
    source_of = {}
    for doc_id, text, source, *_ in rows:
        source_of[doc_id, len((text or "").encode().split())] = source
    for r in digest(df).collect():
        source = source_of[r.doc_id, r.size]
        assert r.source_size == sizes[source] and abs(r.target - wanted[source]) < 1e-6 * max(1, wanted[source])
        assert 0 <= r.taken <= 2 * r.size
        taken[source] += r.taken
    for source, words in taken.items():
        assert abs(words - wanted[source]) <= 1, source


def test_mixture_has_the_words_that_were_taken(spark):
    df = spark.createDataFrame(rows_of(4), SCHEMA)
    mixed = mix(df)
    assert mixed.columns == df.columns
    assert sum(len(r.text.encode().split()) for r in mixed.collect()) == digest(df).agg({"taken": "sum"}).first()[0]


def test_better_documents_are_preferred(spark):
    good = [(i, " ".join(f"w{i}x{j}" for j in range(50)), "a", 0, "", 0) for i in range(200)]
    bad = [(1000 + i, " ".join(["#same"] * 50), "a", 0, "", 0) for i in range(200)]
    other = [(9000 + i, " ".join(f"v{i}x{j}" for j in range(500)), "b", 0, "", 0) for i in range(200)]
    taken = {r.doc_id: r.taken for r in digest(spark.createDataFrame(good + bad + other, SCHEMA), Mix(share=0.1)).collect()}
    assert sum(taken[r[0]] for r in good) > 5 * sum(taken[r[0]] for r in bad)


def test_empty_table_and_tables_without_words(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert digest(empty).count() == 0 and mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a", 0, "", 0), (2, " ", None, 0, "", 0)], SCHEMA)
    assert [r.taken for r in digest(blank).collect()] == [0, 0] and mix(blank).count() == 0
