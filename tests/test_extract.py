"""Edges, groups, units, lyrics and request plans against values worked out by hand."""

import random

from pyspark.sql import functions as F

from tidemark.functions import edges as E
from tidemark.operators import extract as X


def each(spark, f, texts):
    rows = [(i, *(t if isinstance(t, tuple) else (t,))) for i, t in enumerate(texts)]
    names = ["i", "a", "b", "gap"][: len(rows[0])]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n in ('i', 'gap') else 'string'}" for n in names))
    return [r[0] for r in df.orderBy("i").select(f).collect()]


def test_tails_and_heads(spark):
    tails = {"he said,": 4, "Wait...": 2, "so…": 2, "Done.</i> ♪": 1, '"Go!"': 17, "well-": 8, "well--": 1, "（": 32, "end": 0, "": 0, None: 0, "»": 16}
    assert each(spark, E.tail_flags(F.col("a")), list(tails)) == list(tails.values())
    heads = {"<i>hello": 2, "...Hello": 5, "」は": 8, "\"'tis": 2, "- Hi": 4, "♪ 12": 0, "": 0, None: 0, "<b>x": 2}
    assert each(spark, E.head_flags(F.col("a")), list(heads)) == list(heads.values())


def test_sentences_go_on(spark):
    a, b = F.col("a"), F.col("b")
    cases = {
        ("example.", "com is", 100): True, ("End.", "next", 0): False, ("one,", "Two", 1500): True, ("one,", "Two", 1501): False, ("so…", "Then", 100): False,
        ("so…", "…then", 1500): True, ("so…", "…then", 1501): False, ("well-", "known", 200): True, ("well-", "known", 201): False, ("I saw", "Paris", 201): False, ("I saw", "him", 9000): True,
    }
    assert each(spark, E.goes_on(a, E.tail_flags(a), b, E.head_flags(b), F.col("gap")), list(cases)) == list(cases.values())
    captions = {("LONDON", "Hello", 0): False, ("LONDON", "hello", 0): True, ("LONDON,", "Hello", 0): True, ("London", "Hello", 0): True}
    assert each(spark, E.goes_on_latin(a, E.tail_flags(a), b, E.head_flags(b), F.col("gap")), list(captions)) == list(captions.values())


def quote_walk(text, pending):
    for i, c in enumerate(text):
        if c == '"':
            pending = pending if i == 0 and pending else not pending
        elif c in "“「«([":
            pending = True
        elif c in "”」»)]":
            pending = False
    return pending


def test_quotes_left_open(spark):
    random.seed(3)
    texts = ["".join(random.choice('ab"“”()« »') for _ in range(random.randrange(9))) for _ in range(400)]
    for pending in (False, True):
        assert each(spark, E.open_after(F.col("a"), pending), texts) == [quote_walk(t, pending) for t in texts]


def test_turns_and_punctuation(spark):
    texts = {"- Hi. - No.": ["Hi.", "No."], "a-b": ["a-b"], "Yes. -Go": ["Yes.", "Go"], "-- x": ["-- x"], "": [""], "<i>- Oh</i>": ["Oh</i>"]}
    assert each(spark, E.turns(F.col("a")), list(texts)) == list(texts.values())
    parts = spark.createDataFrame([(1, ["a “", "b", "。c"]), (2, []), (3, ["x"]), (4, ['a"', "b"])], "i long, p array<string>").orderBy("i")
    assert [r[0] for r in parts.select(E.place_punctuation(F.col("p"))).collect()] == [["a", "“b。", "c"], [], ["x"], ['a"', "b"]]


def cue_frame(spark, cues):
    return spark.createDataFrame([("d", i + 1, *c) for i, c in enumerate(cues)], "doc_id string, pos long, text string, start_ms long, end_ms long")


def test_groups_and_units(spark):
    cues = [("I went,", 0, 1000), ("home.", 1200, 2000), ('Then she said "wait', 2100, 3000), ('for me" ok.', 3500, 4000), ("...", 4100, 4200), ("Bye now friend.", 4300, 5000), (None, 5100, 5200)]
    rows = X.groups(X.merge_reasons(X.merge_sides(X.segments(cue_frame(spark, cues))))).orderBy("pos").collect()
    assert [r.group for r in rows] == [1, 1, 1, 1, 2, 3, 4]
    assert [r.marked for r in rows] == [False, True, True, False, False, False, False]
    units = X.extract_units(cue_frame(spark, cues)).orderBy("unit").collect()
    assert [(u.unit, u.chapter, u.text, u.resolved) for u in units] == [
        (1, 1, 'I went, home. Then she said "wait for me" ok.', None), (2, 1, "", "..."), (3, 1, "Bye now friend.", None), (4, 1, "", ""),
    ]
    music = [("♪ One ♪", 0, 1000), ("♪ Two", 1100, 2000), ("Speak to me.", 2100, 3000), ("♪ Three", 2900, 3500), ("Far away it goes.", 90000, 91000)]
    units = X.extract_units(cue_frame(spark, music)).orderBy("unit").collect()
    assert [(u.chapter, u.kind, u.text, u.n) for u in units] == [(1, "music", "One Two Three", 3), (2, "dialogue", "Speak to me.", 1), (3, "dialogue", "Far away it goes.", 1)]
    assert X.extract_units(cue_frame(spark, music).where("false")).count() == 0


def test_long_chains_are_cut(spark):
    cues = [(f"word{i} and then more", i * 100, i * 100 + 100) for i in range(40)]
    rows = X.groups(X.merge_reasons(X.merge_sides(X.segments(cue_frame(spark, cues))))).groupBy("group").count().orderBy("group").collect()
    assert [r["count"] for r in rows] == [16, 16, 8]


def test_lyrics_are_set_aside(spark):
    masked = X.mask_lyrics(cue_frame(spark, [("♪ la ♪", 0, 1), ("- Hi. - ♪ la", 1, 2), ("Bye", 2, 3), ("♪ end", 3, 4), (None, 4, 5)]))
    got = [(r.pos, r.lyric, r.mixed, r.ask, r.anchor) for r in masked.orderBy("pos").collect()]
    assert got == [(1, True, False, None, None), (2, False, True, "Hi.", None), (3, False, False, "Bye", 2), (4, True, False, None, 3), (5, False, False, None, 3)]
    back = lambda rows: [(r.pos, r.translation, r.verbatim) for r in X.restore_lyrics(masked, spark.createDataFrame(rows, "doc_id string, pos long, translation string")).orderBy("pos").collect()]
    assert back([("d", 2, "Salut."), ("d", 3, "Adieu")]) == [(1, None, True), (2, "- Salut. - ♪ la", False), (3, "Adieu", False), (4, None, True)]
    assert back([("d", 2, None)]) == [(1, None, True), (2, None, False)]


def test_batches():
    scene, cost = [0, 0, 1, 1], [40, 40, 40, 40]
    assert [X.count_batches(scene, cost, 10, limit) for limit in (100, 200, 60, 20)] == [2, 1, 4, 0]
    assert X.count_batches([0, 1, 0, 2], [40, 500, 40, 10], 10, 110) == 2
    assert X.count_batches([], [], 10, 60) == 0


def test_request_plan(spark):
    cues = [("x" * 60, i * 1000 + (60000 if i >= 50 else 0), i * 1000 + (60000 if i >= 50 else 0) + 900) for i in range(100)]
    rows = cue_frame(spark, cues).withColumn("kind", F.lit("dialogue"))
    one = X.request_plan(rows, 30, 10**6, 10, 5).collect()
    assert [(p.part, p.first_pos, p.last_pos, p.batches) for p in one] == [(1, 1, 100, 1)]
    # A cue costs 60 + 23 + 2 * 3 = 89, a frame is 11: 11 cues in a batch of 1000, so each half takes 5 batches of at most 5.
    two = X.request_plan(rows, 30, 1000, 10, 5).orderBy("part").collect()
    assert [(p.part, p.first_pos, p.last_pos, p.batches) for p in two] == [(1, 1, 50, 5), (2, 51, 100, 5)]
    many = X.request_plan(rows, 30, 300, 10, 2).orderBy("part").collect()
    assert many[0].first_pos == 1 and many[-1].last_pos == 100 and all(a.last_pos + 1 == b.first_pos for a, b in zip(many, many[1:]))
