import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from tidemark.llm import codes
from tidemark.llm.codes import LIMIT, ORACLE_SQL, compress, nearest, overlapping

SCHEMA = "vec_id long, embedding array<float>, label int, code int, error string, n int"


def by_hand(rows):
    """Everything in Python's whole numbers."""
    kept = [(i, [max(-LIMIT, min(LIMIT, math.floor(1024 * float(np.float32(x))))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(np.float32(x)) for x in v)]
    lengths = [len(v) for _, v, _ in kept]
    d = max(set(lengths), key=lambda n: (lengths.count(n), n))
    kept = [(i, v + [0] * (-d % 4), label) for i, v, label in kept if len(v) == d]
    m = len(kept[0][1]) // 4
    parts = [[v[p * m : p * m + m] for _, v, _ in kept] for p in range(4)]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:256]
    books = [[parts[p][k] for k in first] for p in range(4)]
    best = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(4):
        for p in range(4):
            near = [best(x, books[p])[1] for x in parts[p]]
            for e in set(near):
                mine = [x for x, k in zip(parts[p], near, strict=True) if k == e]
                books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = [[best(parts[p][k], books[p]) for p in range(4)] for k in range(len(kept))]
    errors = [sum(e for e, _ in f) for f in found]
    by_label = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for _, e in f), err, by_label[label], sha) for (i, _, label), f, err in zip(kept, found, errors, strict=True)), key=str)


def rows_of(n, d, seed, ties=False):
    rnd = random.Random(seed)
    draw = (lambda: rnd.choice([-1.0, 0.0, 1.0])) if ties else (lambda: rnd.gauss(0, 0.2))
    return [(i, [draw() for _ in range(d)], rnd.choice([0, 1, 1, 1, None])) for i in range(n)]


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, compress(df).collect()), key=str)


@pytest.mark.parametrize("ties", [False, True])
def test_against_whole_numbers(spark, ties):
    rows = rows_of(400, 8, 1, ties)
    rows += [rows[3], rows[3], (None, rows[5][1], None), (900, None, 1), (901, [float("nan")] * 8, 1), (902, [float("inf")] * 8, 1), (903, [None] * 8, 1), (904, [1.0] * 4, 1), (905, [], 1)]
    assert run(spark, rows) == by_hand(rows)


def test_few_vectors_odd_lengths_and_large_numbers(spark):
    for rows in (rows_of(9, 7, 2), rows_of(5, 4, 3) + [(50, [3e38, -3e38, 1e6, 0.0], 1)], [(1, [], None), (2, [], 4)]):
        assert run(spark, rows) == by_hand(rows)
    assert run(spark, []) == [] and run(spark, [(1, None, 2)]) == []


def test_intervals_hold_the_true_distances():
    """Entries that differ by less than float32 can tell, and large components: the exact best is always among them."""
    rnd = np.random.default_rng(4)
    for scale in (1, 1000, LIMIT):
        book = rnd.integers(-scale, scale + 1, (256, 16))
        book[100:] = book[:156] + rnd.integers(-1, 2, (156, 16))
        x = np.concatenate([book[:50] + rnd.integers(-1, 2, (50, 16)), rnd.integers(-scale, scale + 1, (50, 16))])
        found = nearest(x, book)
        for k, row in enumerate(x.tolist()):
            wanted = min((sum((a - b) ** 2 for a, b in zip(row, c, strict=True)), e) for e, c in enumerate(book.tolist()))
            assert (int(found[1][k]), int(found[0][k])) == wanted
    entries = overlapping(np.arange(32).reshape(2, 16), np.zeros((256, 16), dtype=np.int64))[1]
    assert len(entries) == 512  # equal entries are all looked at
    spread = np.arange(256)[:, None] * np.full(16, 1000)
    assert len(overlapping(spread[:7], spread)[1]) == 7  # and only the best where the others are far


def test_sql(spark, tmp_path):
    rows = rows_of(300, 16, 5)
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).select("vec_id", "embedding", "label")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = compress(df)
    assert sorted(map(str, con.sql(f"SELECT {', '.join(got.columns)} FROM ({ORACLE_SQL})").fetchall())) == sorted(str(tuple(r)) for r in got.collect())


def test_steps_make_no_difference(monkeypatch):
    rnd = np.random.default_rng(6)
    x, book = rnd.integers(-3, 4, (50, 4)), rnd.integers(-3, 4, (20, 4))
    whole = nearest(x, book)
    monkeypatch.setattr(codes, "STEP", 7)
    assert all(np.array_equal(a, b) for a, b in zip(whole, nearest(x, book), strict=True))
