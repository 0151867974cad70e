import zlib

import numpy as np

from tidemark.llm.langid import Profiler, Space, digest, identify, prototypes

SMOKE = "/root/testdata/sf0.01"


def by_hand(profiler, text):
    """Bundles the text's trigrams one by one."""
    chars = [c if c.isalpha() else " " for c in " " + text.lower() + " "]
    chars = [c for i, c in enumerate(chars) if c != " " or i == 0 or chars[i - 1] != " "]
    out = np.zeros(profiler.space.dimensions)
    for a, b, c in zip(chars, chars[1:], chars[2:], strict=False):
        if b != " ":
            v = [profiler.letters[profiler.symbol[ord(x)]].astype(int) for x in (a, b, c)]
            out += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
    return out


def test_bundles_against_single_trigrams():
    profiler = Profiler(Space(256))
    texts = ["Hello, wörld!", "", "a", "42", "ab  cd\nÉé", "日本語 テキスト"]
    got = profiler.bundle(texts)
    for text, vector in zip(texts, got, strict=True):
        assert np.array_equal(vector, by_hand(profiler, text)), text
    together = profiler.bundle(texts, np.array([0, 1, 0, 1, 0, 1]))
    assert np.array_equal(together[0], got[0] + got[2] + got[4])
    many = Profiler(Space(256)).bundle([*texts, "".join(map(chr, range(0x4E00, 0x4F00)))])
    assert np.array_equal(many[: len(texts)], got)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    got = digest(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    tested = [r for r in got if r.held_out and r.lang is not None and r.lang_pred != "und"]
    assert sum(r.lang == r.lang_pred for r in tested) / len(tested) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_only_text_counts(spark):
    df = spark.createDataFrame([(0, "the cat", "en", 3), (2, "der hund", "de", 3), (4, None, "de", 3), (5, "12 !", None, 3), (None, "the cat", None, 3), (6, "the cat " * 20_000, "en", 3), (0, "the cat", "en", 3)], "doc_id long, text string, lang string, score int")
    got = digest(df).collect()
    assert len(got) == 7
    assert {r.lang_pred for r in got if r.doc_id in (4, 5)} == {"und"}
    assert identify(df.select("doc_id", "text"), {}).where("lang_pred <> 'und' OR score <> 0").count() == 0


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert prototypes(empty) == {} and digest(empty).count() == 0
