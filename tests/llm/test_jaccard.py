import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import components as parts
from tidemark.llm import jaccard
from tidemark.llm.components import components
from tidemark.llm.jaccard import Fragments, Rule, keep_one_of_each, linked_documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    words = (text or "").translate(LOWER).encode().split()
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def by_hand(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted((rows[i][0], len(sets[i]), least[find(i)], links[i]) for i in range(len(rows)))


def corpus(seed, n=90):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Éa", "A", "a", "B,"]
    bases = [[rnd.choice(vocabulary) for _ in range(rnd.choice([1, 3, 4, 9, 12, 30, 120, 400]))] for _ in range(9)]
    out = []
    for i in range(n):
        words = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4, 8])):
            at = rnd.randrange(len(words))
            words[at : at + rnd.choice([0, 1])] = [rnd.choice(vocabulary)] * rnd.choice([0, 1, 1])
            words = words or ["w"]
        out.append((i, rnd.choice([" ", "\n"]).join(words)))
    return out + [(1000, None), (1001, "  "), (1002, "w1 w2"), (1003, "W1\tw2")]


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 4, 85), (2, 5, 80), (3, 1, 50)])
def test_against_brute_force(spark, seed, k, percent):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, sid string, n int").repartition(3)
    assert sorted(tuple(r) for r in linked_documents(df, k, percent).collect()) == by_hand(rows, k, percent)


def test_blocks_agree(spark, monkeypatch):
    rows = corpus(5, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 4)
    monkeypatch.setattr(jaccard, "BROADCAST_SETS", 0)
    assert sorted(tuple(r) for r in linked_documents(df).collect()) == by_hand(rows, 4, 85)


def test_linked_sets_share_a_signature():
    rnd = np.random.default_rng(1)
    rule = Rule(4, 85)
    fragments = Fragments(rule)
    for _ in range(400):
        n = int(rnd.integers(7, 400))
        a = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64))
        out = int(rnd.integers(0, rule.differing(n) + 1))
        b = np.unique(np.concatenate([a[rnd.permutation(len(a))[out // 2 :]], rnd.integers(0, 2**63, out - out // 2).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both) and both < max(len(a), len(b)):
            assert np.intersect1d(fragments.signatures(a), fragments.signatures(b)).size


def test_ids_rows_and_empty_table(spark):
    text = " ".join(f"t{i}" for i in range(50))
    df = spark.createDataFrame([(None, text), (4, text), (4, text), (9, "a b"), (9, "c d"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.n_links) for r in linked_documents(df).collect()), key=str)
    assert got == sorted([(None, 4, 2), (4, 4, 2), (4, 4, 2), (9, 9, 0), (9, 9, 0), (None, None, 0)], key=str)
    kept = keep_one_of_each(df)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(None, text), (9, "a b"), (9, "c d"), (None, None)], key=str)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert linked_documents(empty).count() == 0
    assert keep_one_of_each(empty).count() == 0


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(230)] + [(1000 + i, 1001 + i) for i in range(80)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert all(root[x] == got.get(x, x) for x in root)


@pytest.mark.parametrize("labels", [(1, 2, 3, 5), (10, 40, 70, 90), (4, 6, 7, 8)])
def test_components_when_a_node_has_two_lesser_ones(spark, monkeypatch, labels):
    """The first pass, in a task for each u, leaves (d, b), (c, b) and (c, a): no v is a u, but c has two."""
    monkeypatch.setattr(parts, "CHUNK", 2)
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "2", "spark.sql.shuffle.partitions": "31"}
    before = {k: spark.conf.get(k) for k in conf}
    a, b, c, d = labels
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        found = components(spark.createDataFrame([(d, c), (d, b), (c, a)], "a long, b long")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, found)) == [(x, a) for x in labels]


def test_equal_digests_lose_no_count():
    """Fragments of one set that agree in their digest count each; a set that was sent twice counts once."""
    from tidemark.llm.jaccard import _counted

    def sent(*sets):
        sid, meta, digests = zip(*sets, strict=True)
        return [np.array(sid, dtype=np.int64).tobytes(), np.array(meta, dtype=np.uint32).tobytes(), np.array([len(d) for d in digests], dtype=np.uint32).tobytes(), np.array([x for d in digests for x in d], dtype=np.uint32).tobytes()]

    held = [sent((1, 6, [7, 7, 9]), (2, 6, [7, 7, 9, 4])), sent((1, 6, [7, 7, 9]), (3, 4, [5, 5]), (4, 1, [8]))]
    rows = _counted([[pa.py_buffer(x) for x in part] for part in held]).to_pylist()
    assert sorted((r["sid"], r["meta"], r["shared"]) for r in rows) == [(1, 6, 3), (2, 6, 3), (4, 1, 0)]


def test_chained_clusters_come_apart(spark, monkeypatch):
    """Sets that have only a passage in common make one cluster; blocks are not dealt out for it, and no link is lost."""
    rnd = random.Random(7)
    fresh = lambda n: [f"x{rnd.randrange(10**9)}" for _ in range(n)]
    passages = [fresh(60) for _ in range(12)]
    families = [fresh(60) + passages[i] + passages[(i + 1) % 12] for i in range(12)]
    rows = []
    for i, words in enumerate(families):
        for j in range(4 if i else 40):
            copy = list(words)
            copy[rnd.randrange(60)] = fresh(1)[0]
            rows.append((100 * i + j, " ".join(copy)))
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 8)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    seen = []
    sizes = jaccard._sizes
    monkeypatch.setattr(jaccard, "_sizes", lambda placed: seen.append(sizes(placed)) or seen[-1])
    assert sorted(tuple(r) for r in linked_documents(df, 5, 80).collect()) == by_hand(rows, 5, 80)
    before, after = ([r.sets for r in x.select("sets").collect()] for x in seen)
    # What fits a block is left together.
    assert max(before) > 40 and sum(after) == 84 and sorted(after)[-2:] == [8, 40]


def test_rare_fragments_and_frequent_ones(spark, monkeypatch):
    rows = corpus(11, 80)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 1)
    for few in (1, 3, 6, 1000):
        monkeypatch.setattr(jaccard, "FEW_SETS", few)
        assert sorted(tuple(r) for r in linked_documents(df, 4, 85).collect()) == by_hand(rows, 4, 85)


def test_a_set_has_one_id_a_range():
    """Both entries of a set travel under one id, and come back as they were."""
    from tidemark.llm.jaccard import _counted, _entries, _sent

    rnd = np.random.default_rng(3)
    sets = [np.unique(rnd.integers(0, 2**63, n).astype(np.uint64)) for n in (9, 40, 700)]
    cut = Fragments(Rule(5, 80)).cut([*sets, sets[1]], wide=True)
    names = np.array([5, 6, 7, 8])
    sent = _sent([(cut, names)], 3).to_pylist()
    assert sum(len(r["digests"]) for r in sent) == 4 * len(cut.sigs)
    assert all(len(r["sids"]) // 8 == len(set(np.frombuffer(r["sids"], dtype=np.int64).tolist())) for r in sent)
    total = {}
    for r in sent:
        for row in _counted([_entries(*(pa.py_buffer(r[c]) for c in ("sids", "metas", "counts", "digests")))]).to_pylist():
            total[row["sid"], row["meta"] & 1] = total.get((row["sid"], row["meta"] & 1), 0) + row["shared"]
    full = {(int(names[o]), int(u)): int((cut.entry == e).sum()) for e, (o, u) in enumerate(zip(cut.owner, cut.up, strict=True))}
    assert {k: n for k, n in total.items() if n} == {k: n for k, n in full.items() if k[0] in (6, 8)}


def test_components_of_a_chain_and_hubs_take_few_tables(spark, monkeypatch):
    """A round writes two tables, though edges are double and chunks small."""
    monkeypatch.setattr(parts, "CHUNK", 3)
    written, stash = [], parts.stash
    monkeypatch.setattr(parts, "stash", lambda df: written.append(1) or stash(df))
    edges = [(i, i + 1) for i in range(40)] * 2 + [(100 + i, x) for i in range(30) for x in (99, 98, 100 + (i * 7) % 30)] + [(500, 500)]
    random.Random(9).shuffle(edges)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        found = components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, found)) == [(i, 0) for i in range(41)] + [(x, 98) for x in range(98, 130)]
    assert 5 <= len(written) <= 11


def test_edges_of_one_node_stay_in_one_chunk():
    batches = [pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())}) for u, v in (([5, 8], [1, 2]), ([8, 8], [3, 2]), ([8, 9], [4, 1]))]
    found = [x.to_pydict() for x in parts._forest(iter(batches), 2, whole=True)]
    assert sorted((u, v) for x in found for u, v in zip(x["u"], x["v"], strict=True)) == [(3, 2), (4, 2), (5, 1), (8, 2), (9, 1)]


def test_a_bitmap_is_read_back_by_one_job(spark):
    """Not by one for each partition: on many partitions, mostly empty, these took longer than all else."""
    from tidemark.llm import sketch

    before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    keys = spark.range(50).selectExpr("id * 1000003 AS __k")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.sparkContext.setJobGroup("bitmap", "bitmap")
        known = sketch.build(keys, sketch.counted("__k"), 1 << 23, least=1)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("bitmap")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert known.value.repeated((np.arange(50) * 1000003).astype(np.uint64)).all()
    assert len(jobs) == 1
