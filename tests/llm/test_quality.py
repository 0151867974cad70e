import random
from collections import Counter

import duckdb
import pytest

from tidemark.llm import quality
from tidemark.llm.quality import Rules, judge, keep_good


def by_hand(text):
    words = (text or "").encode().split()
    n = len(words)
    count = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    covered = {i + j for i in range(n - 2) if count[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (n, sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


def corpus(seed, n=200):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        words = [rnd.choice(["a", "bé", "ccc", "x#", "|", "long-word", "Yes."]) if rnd.random() < 0.3 else f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([0, 1, 2, 3, 49, 60, 200]))]
        if rnd.random() < 0.2:
            words = words[:7] * 20
        text = "".join(w + rnd.choice([" ", "\n", "\t", "\r\n", " \x0b"]) for w in words)
        out.append((i, rnd.choice([text, text + "same line\nsame line\n\n \n"]), rnd.choice(["en", "de", None]), rnd.choice(["s0", "s0", "s1", None])))
    return out + [(None, None, "en", "s0"), (7, "", None, None), (7, "", None, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_base_and_sql(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_words int")
    got = sorted((tuple(r) for r in judge(df).collect()), key=str)
    wanted = sorted(((i, *by_hand(t)) for i, t, _, _ in rows), key=str)
    assert [r[:-1] for r in got] == wanted
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.sql(quality.ORACLE_SQL).fetchall(), key=str) == got


def test_thresholds_follow_the_group(spark):
    rnd = random.Random(5)
    plain = [(i, " ".join(f"word{rnd.randrange(10**6)}" for _ in range(100)), "en", "a") for i in range(120)]
    marked = [(1000 + i, " ".join(f"w#{rnd.randrange(10**6)}" for _ in range(100)), "en", "b") for i in range(120)]
    odd = [(5000, " ".join(f"w#{rnd.randrange(10**6)}" for _ in range(100)), "en", "a")]
    df = spark.createDataFrame(plain + marked + odd, "doc_id long, text string, lang string, source string")
    assert [r.doc_id for r in judge(df).where("NOT kept").collect()] == [5000]
    assert keep_good(df).count() == 240
    few = judge(df, Rules(least_group=1000))  # then all take the corpus's fences
    assert few.where("doc_id = 5000").first().kept == few.where("doc_id = 1000").first().kept


def test_salted_join_agrees(spark, monkeypatch):
    df = spark.createDataFrame(corpus(3), "doc_id long, text string, lang string, source string")
    wanted = sorted(map(str, judge(df).collect()))
    monkeypatch.setattr(quality, "BROADCAST_GROUPS", -1)
    assert sorted(map(str, judge(df).collect())) == wanted
    assert sorted(map(str, keep_good(df).collect())) == sorted(map(str, keep_good(df).collect()))


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame(corpus(3), "doc_id long, text string, lang string, source string")
    plan = keep_good(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert judge(df).count() == 0 and keep_good(df).count() == 0
