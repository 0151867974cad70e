import math

import duckdb
import numpy as np
import pytest

from tidemark.llm import mtree
from tidemark.llm.mtree import ORACLE_SQL, MTree, products, top_k

SCHEMA = "vec_id long, embedding array<float>, score int, part int"


def by_hand(rows, k=20, every=20):
    good = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole = [math.floor(64 * float(np.float32(x))) for x in v]
            good[i] = min(good.get(i, whole), whole)
    out = []
    for q, v in good.items():
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good.items() if i != q and len(w) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize(("dimensions", "spread"), [(2, 0.2), (8, 1.0), (64, 0.1)])
def test_tree_against_all_products(dimensions, spread):
    rnd = np.random.default_rng(dimensions)
    centres = rnd.normal(size=(6, dimensions)) * 40
    vectors = np.floor(centres[rnd.integers(0, 6, 700)] + rnd.normal(size=(700, dimensions)) * 64 * spread).astype(np.int64)
    vectors[100:300] = vectors[0]
    ids = rnd.permutation(700).astype(np.int64)
    tree = MTree(ids, vectors, page=16)
    for q in vectors[::23]:
        scored = sorted((-s, i) for s, i in zip(products(vectors, q), ids.tolist(), strict=True))
        assert tree.best(q, 20) == [(-s, i) for s, i in scored[:20]]


def test_bounds_avoid_computations(monkeypatch):
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(40, 3)) * 500
    vectors = np.floor(np.repeat(centres, 50, axis=0) + rnd.normal(size=(2000, 3))).astype(np.int64)
    seen = []
    plain = MTree._scores
    monkeypatch.setattr(MTree, "_scores", lambda self, node, keep, *rest: seen.append(len(keep)) or plain(self, node, keep, *rest))
    tree = MTree(np.arange(2000), vectors, page=32)
    tree.best(vectors[7], 5)
    assert sum(seen) < 1000


def test_query_against_brute_force_and_sql(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rnd.normal(size=5).astype(np.float32)], 1, 1) for i in range(300)]
    rows += [(300 + i, rows[40][1], 1, 1) for i in range(70)]
    rows += [(1000, None, 1, 1), (1020, [1.0, None, 0.0, 0.0, 0.0], 1, 1), (1040, [float("nan")] * 5, 1, 1), (1060, [float("inf")] * 5, 1, 1), (-20, [0.5] * 5, 1, 1)]
    monkeypatch.setattr(mtree, "PART", 64)
    monkeypatch.setattr(mtree, "BLOCK", 3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in top_k(df).collect())
    assert got == by_hand(rows)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", [r[:2] for r in rows])
    assert sorted(con.sql(ORACLE_SQL).fetchall()) == got


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0], 1, 1), (0, [1.0, 2.0], 1, 1), (0, [0.5, 9.0], 1, 1), (None, [1.0, 2.0], 1, 1), (3, [1.0], 1, 1), (20, [1.0], 1, 1), (7, [2.0, 2.0], 1, 1), (40, [3e5, 1.0], 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(tuple(r) for r in top_k(df).collect()) == by_hand(rows)
    assert top_k(df.limit(0)).count() == 0
