import random

import numpy as np
import pytest

from tidemark.llm import suffix
from tidemark.llm.suffix import SuffixArray, digest, digest_by_hand
from tidemark.llm.textwords import Hasher


def run(spark, rows, least=100, parts=3):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, body string").repartition(parts)
    return sorted(tuple(r) for r in digest(df, least).collect())


def corpus(seed, n=50):
    rnd = random.Random(seed)

    def some(k):
        return "".join(rnd.choice("abcdé ñ\n€") for _ in range(k))

    passages = [some(k) for k in (60, 99, 101, 130, 400, 900)]
    out = []
    for i in range(n):
        parts = [some(rnd.choice([0, 5, 80, 300]))]
        for _ in range(rnd.choice([0, 1, 2])):
            p = rnd.choice(passages)
            parts += [p[rnd.choice([0, 0, 7]) : len(p) - rnd.choice([0, 0, 11])], some(rnd.choice([0, 1, 40]))]
        if rnd.random() < 0.15:
            parts = [rnd.choice(["ab", "z", "xyz"]) * rnd.randrange(300)]
        out.append((i * 2, "".join(parts)))
    return out + [(1000, None), (1001, ""), (1002, out[7][1]), (1, out[30][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == sorted((i, *r) for i, r in digest_by_hand(rows).items())


def test_split_grams_agree(spark, monkeypatch):
    rows = corpus(3)
    monkeypatch.setattr(suffix, "HOT", 3)
    monkeypatch.setattr(suffix, "CHUNK", 500)
    assert run(spark, rows) == sorted((i, *r) for i, r in digest_by_hand(rows).items())


def test_maximal_repeats_list_all_occurrences():
    rnd = random.Random(4)
    for _ in range(60):
        parts = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 14))) for _ in range(5)]
        off = np.cumsum([0, *map(len, parts)])
        text = "".join(parts)
        found = SuffixArray(np.frombuffer(text.encode(), dtype=np.uint8), off, 3, Hasher(1))
        got = {(n, tuple(at)) for n, at in found.maximal_repeats(3)}
        places: dict[str, list[int]] = {}
        for a, b in zip(off, off[1:], strict=False):
            for i in range(a, b):
                for j in range(i + 3, b + 1):
                    places.setdefault(text[i:j], []).append(int(i))
        wanted = set()
        for s, at in places.items():
            left = {-i - 1 if i in off else text[i - 1] for i in at}
            right = {-i - 1 if i + len(s) in off else text[i + len(s)] for i in at}
            if len(at) > 1 and len(left) > 1 and len(right) > 1:
                wanted.add((len(s), tuple(sorted(at))))
        assert got == wanted


def test_rows_ids_and_empty_table(spark):
    text = "".join(chr(97 + i * i % 26) + str(i) for i in range(60))
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (7, "s"), (7, "t")], "doc_id long, text string")
    n = len(text)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in digest(df).collect()), key=str)
    assert got == sorted([(5, n, n, 1), (5, n, n, 1), (None, n, 0, 0), (7, 1, 0, 0), (7, 1, 0, 0)], key=str)
    assert digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
