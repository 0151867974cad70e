import random
import zlib

import numpy as np

from tidemark.llm.toxicity import Grams, Model, digest, odds, sampled, score, train

SMALL = Model(rows_bits=12, epochs=40, most_toxic=200, most_clean=400)


def grams_by_hand(text):
    out = []
    for word in "".join(c if c.isalnum() else " " for c in text.lower()).split():
        padded = f"<{word}>"
        out.append(sorted(padded[i : i + n] for n in (3, 4, 5) for i in range(len(padded) - n + 1)))
    return out


def test_grams_stay_inside_words():
    texts = ["Ab, cde!", "", "é 日本 x2", "..."]
    rows, words, owner = Grams(20).of(texts)
    wanted = [w for t in texts for w in grams_by_hand(t)]
    assert np.bincount(words, minlength=len(owner)).tolist() == [len(w) for w in wanted]
    assert owner.tolist() == [0, 0, 2, 2, 2]
    again, _, _ = Grams(20).of(["cde"])
    assert set(again) <= set(rows)


def corpus(n, seed):
    rnd = random.Random(seed)
    bad, words = ["grumblix", "snarfle", "blortch"], [f"w{i}or" for i in range(400)]
    out = []
    for i in range(n):
        text = [rnd.choice(words) for _ in range(rnd.choice([20, 80, 300]))]
        toxic = int(rnd.random() < 0.3)
        if toxic:
            for _ in range(max(1, len(text) // 30)):
                text[rnd.randrange(len(text))] = rnd.choice(bad)
        out.append((i, " ".join(text), toxic))
    return out


def test_unseen_misspellings_share_vectors():
    rows = corpus(500, 1)
    numbers, intercept = train([t for _, t, _ in rows], np.array([y for *_, y in rows]), SMALL)
    of = lambda t: odds([t], Grams(12), numbers, intercept, SMALL)[0]
    plain = " ".join(f"w{i}or" for i in range(30))
    assert of(plain + " grumblixx") > of(plain + " w7or") + 1
    assert of(plain + " grumblix") > 0 > of(plain)


def test_held_out(spark):
    rows = corpus(900, 2)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(5000, None, "x"), (5001, "", "x"), (None, "grumblix", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(5000, None, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    got = digest(docs, labels, SMALL).collect()
    assert len(got) == len(rows) + 3
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95


def test_sample_is_bounded_and_one_class_is_enough(spark):
    rows = corpus(100, 3)
    every = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs = every.select("doc_id", "text")
    texts, labels = sampled(docs.union(docs), every.select("doc_id", "toxic"), Model(most_toxic=5, most_clean=7))
    assert set(zip(texts, labels.tolist(), strict=True)) <= {(t, y) for _, t, y in rows}
    assert 0 < labels.sum() <= 5 and len(texts) <= 12
    clean = spark.createDataFrame([(i, 0) for i in range(100)], "doc_id long, toxic int")
    assert digest(docs, clean, SMALL).where("predicted = 1").count() == 0
    assert digest(docs.limit(0), clean.limit(0), SMALL).count() == 0
    assert score(docs.limit(0), np.zeros(4096, dtype=np.float32), 0.0, SMALL).count() == 0


def test_longest_part_bounds_the_texts_trained_on(spark):
    from tidemark.llm.toxicity import Model, sampled

    docs = spark.createDataFrame([(1, "bad " * 100), (2, "bad"), (3, "good")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id long, toxic int")
    longest = lambda **k: max(len(t) for t in sampled(docs, labels, Model(most_bytes=2000, **k))[0])
    assert longest() == 4 and longest(longest_part=1) == 400
