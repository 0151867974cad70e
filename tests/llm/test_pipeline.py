from collections import Counter

import duckdb
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tidemark.llm import quality  # noqa: E402
from tidemark.llm.pii import Scoring, mask  # noqa: E402
from tidemark.llm.session import stash  # noqa: E402

SMOKE = "/root/testdata/sf0.001"


def classes(texts):
    """Brute force: the rows that stay of groups of documents linked at 80 percent of five-word shingles."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, text in texts.items():
        words = text.translate(lower).encode().split()
        sets[i] = {tuple(words[j : j + 5]) for j in range(len(words) - 4)} or {tuple(words)}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in texts if find(i) == i}


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    columns = docs.columns
    text = {r.doc_id: r.text for r in docs.collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMOKE}/documents.parquet'")
    good = {r[0] for r in con.sql(f"SELECT doc_id FROM ({quality.ORACLE_SQL}) WHERE kept").fetchall()}
    wanted = [lambda: good, lambda: classes({i: text[i] for i in good})]
    steps, kept = [], None
    for name, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, SMOKE))
        steps.append((name, docs))
    found = dict(steps)
    assert [n for n, _ in steps] == ["quality_rules", "ngram_jaccard_join", "pii", "mixing", "packing"]
    for (name, df), want in zip(steps[:2], wanted, strict=False):
        assert df.columns == columns
        kept = {r.doc_id for r in df.collect()}
        assert kept == want(), name
    masked = {r.doc_id: r.text for r in found["pii"].collect()}
    assert masked == {i: mask(text[i], Scoring()) for i in kept}
    copies = Counter()
    for r in found["mixing"].collect():
        copies[r.doc_id] += len(r.text.split())
        assert masked[r.doc_id] == r.text or " ".join(masked[r.doc_id].split()).startswith(r.text)
    assert all(n <= 2 * len(masked[i].split()) for i, n in copies.items())
    total = sum(len(t.split()) for t in masked.values())
    assert abs(sum(copies.values()) - 1.5 * total) <= 20
    pieces = found["packing"].collect()
    assert {r.doc_id for r in pieces} == set(copies)
    whole = Counter()
    for r in found["mixing"].collect():
        whole[r.doc_id] += 1
    assert Counter(r.doc_id for r in pieces if r.start == 0) == whole


def test_run_equals_the_stages(spark):
    rows = sorted(map(tuple, corpus_pipeline.run(spark, SMOKE).collect()))
    assert rows == sorted(map(tuple, corpus_pipeline.run(spark, SMOKE).collect())) and rows
