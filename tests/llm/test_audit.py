import re
from collections import Counter
from itertools import permutations

import duckdb

from tidemark.llm.audit import ORACLE_SQL, audit, lattice_edges, lattice_paths

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def by_hand(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    rows = []
    for i, text, source in docs:
        text = text or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        bad = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and i > least[text]}
        rows.append((source or "", "".join(f for f in "ABCDE" if bad[f]), i in good, i in toxic))
    out = []
    for part in {r[0] for r in rows}:
        steps, shapley = [], Counter()
        mine = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                kept = [r for r in left if f not in r[1]]
                failing = sum(f in r[1] for r in mine)
                shapley[f] += len(gone)
                steps.append((f, (part, "".join(order), k + 1, len(kept), len(gone), failing - len(gone), sum(r[1] == f for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone))))
                left = kept
        out += [(*row, shapley[f]) for f, row in steps]
    return sorted(out)


WORDS = [f"word{i}" for i in range(300)]
FINE = " ".join(WORDS)
DOCS = [(i, FINE + f" {i}", "web") for i in range(5)] + [
    (10, FINE, "web"), (11, FINE, "books"), (3, FINE, None), (12, FINE, ""), (12, FINE, ""), (None, FINE, "web"),
    (13, None, "web"), (14, "", "web"), (15, " \t", "books"), (16, "one # two", "web"), (17, "x " * 500, "web"), (18, "X Y " * 300, "books"), (17, "x " * 500, "web"),
    (19, "\x1c" + FINE + " Ä€𝔸", "web"), (20, "A" * 100_000 + " " + FINE * 50, "long"), (None, None, None), (21, " ".join(WORDS[:200]), "web"), (22, " ".join(WORDS[:199]), "web"),
]
LABELS = [(10, 1, 0), (11, 1, 1), (13, 0, 1), (16, None, 1), (17, 1, None), (17, 0, 1), (999, 1, 1), (None, 1, 1), (20, 1, 0)]


def frames(spark):
    docs = spark.createDataFrame([(*r, 1, 2) for r in DOCS], "doc_id long, text string, source string, n int, failed int").repartition(3)
    return docs, spark.createDataFrame([(*r, "x") for r in LABELS], "doc_id long, quality int, toxic int, part string")


def test_against_walking_every_order(spark):
    got = audit(*frames(spark))
    assert got.columns == COLUMNS
    rows = sorted(map(tuple, got.collect()))
    assert rows == by_hand(DOCS, LABELS)
    parts = {r[0] for r in rows}
    assert parts == {"", "web", "books", "long"} and len(rows) == 600 * len(parts)


def test_empty_tables(spark):
    docs, labels = frames(spark)
    assert audit(docs.limit(0), labels).count() == 0
    assert sorted(map(tuple, audit(docs, labels.limit(0)).collect())) == by_hand(DOCS, [])


def test_sql(spark, tmp_path):
    con = duckdb.connect()
    for name, df in zip(("documents", "labels"), frames(spark), strict=True):
        df.write.parquet(str(tmp_path / name))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    assert sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE_SQL})").fetchall()) == by_hand(DOCS, LABELS)


def test_lattice(spark):
    assert len(lattice_edges()) == 80
    rows = lattice_paths(spark).collect()
    assert len(rows) == 600 and {(r.applied, r.filter) for r in rows} == set(lattice_edges())
