"""Cuts of translations: alignment against all assignments, the ladder against values worked out by hand."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from tidemark.operators import merging as G


def worth(found, targets, tolerances, places):
    top = max(tolerances) + 1
    return sum(top - abs(p - targets[i]) for i, p in found.items())


def test_alignment_is_the_best_of_all():
    random.seed(5)
    for _ in range(300):
        targets = sorted(random.randrange(40) for _ in range(random.randrange(1, 5)))
        places = sorted(random.sample(range(40), random.randrange(1, 6)))
        tolerances = [random.randrange(12) for _ in targets]
        every = [
            dict(zip(a, b, strict=True))
            for n in range(min(len(targets), len(places)) + 1)
            for a in combinations(range(len(targets)), n)
            for b in combinations(places, n)
            if all(abs(p - targets[i]) <= tolerances[i] for i, p in zip(a, b, strict=True))
        ]
        got = G.align(targets, tolerances, places)
        assert got in every or not got
        assert worth(got, targets, tolerances, places) == max(worth(e, targets, tolerances, places) for e in every)
    assert G.align([], [], [1]) == {} and G.align([1.0], [2.0], []) == {}


def test_cuts():
    text = "Well, he came home. Then nothing"
    assert G.anchors(text, ["comma", "period"], [7.0, 18.0]) == {0: 5, 1: 19}
    assert G.cut(text, ["comma", "period"], [7.0, 18.0]) == [(5, "original"), (19, "original")]
    # A cut without a sign at its source takes one nearby, else the nearest word, else the place itself.
    assert G.cut("one two, three four", [None], [9.0]) == [(8, "inferred")]
    assert G.cut("one two three four", ["period"], [9.0]) == [(8, None)]
    assert G.cut("abcdefgh", [None], [2.5]) == [(2, None)]
    assert G.cut("so (he said) yes", [None], [4.0]) == [(3, "inferred")]
    assert G.cut("", ["comma"], [0.0]) == [(0, None)] and G.cut(None, [None], [0.0]) == [(0, None)]
    assert G.cut("ab", [None, None, None], [0.5, 1.0, 1.5]) == [(1, None), (2, None), (2, None)]
    assert G.sign_ends(r"\.{2,}|…+", "(…yes…") == [6]


def test_kinds_and_rows(spark):
    kinds = {"a—": "trail_off", "a.. ": "trail_off", "a,": "comma", "a.”": "period", "a:": "colon", "a": None, "": None, None: None}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(kinds)], "i long, t string").orderBy("i")
    assert [r[0] for r in df.select(G.boundary(F.col("t"))).collect()] == list(kinds.values())
    units = spark.createDataFrame([(1, "Well, he came home.", ["comma"], [7.0]), (2, None, [None], [0.0]), (3, "x", [], [])], "u long, text string, kinds array<string>, expected array<double>")
    assert sorted(map(tuple, G.cut_translations(units, ["u"]).collect())) == [(1, 1, 5, "original"), (2, 1, 0, None)]
    assert G.cut_translations(units.where("false"), ["u"]).count() == 0
