"""Translations cut for their cues: places against Python's patterns, single cuts against all positions, each rule against
values worked out by hand or all its choices, and the whole way back."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import checks
from tidemark.operators import extract as X
from tidemark.operators import merging as G
from tidemark.operators import restoring as R

SIGNS = ["ab", "Cd", "it's", "3.5%", "12", "，", "。", ", ", ". ", "...", "…", "—", ": ", "(", ")", "「", "」", "《", "》", " ", "  ", "世界", "你", "😀", "<i>x</i>", "⟦c12⟧", "U.S."]


def some_texts(n, seed, parts=SIGNS):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(parts) for _ in range(rnd.randrange(14))) for _ in range(n)]


def test_spans_and_weights(spark):
    given = some_texts(250, 1)
    df = spark.createDataFrame(list(enumerate(given)), "i int, t string")
    rules = R.Rules(quotes=("「", "」"))
    spans = R.protected_spans(F.col("t"), rules, F.lit(True), F.array(F.lit("世"), F.lit(""), F.lit("b,")))
    rows = df.select("i", spans.alias("spans"), R.weights(F.col("t")).alias("w")).withColumn("islands", R.islands(F.col("spans")))
    rows = rows.withColumn("out", F.transform(F.sequence(F.lit(0), F.lit(30)), lambda p: F.struct(R.inside(F.col("islands"), p).alias("inside"), R.escape(F.col("spans"), p).alias("at"))))
    units = R.UNITS.replace("\\u", "\\u")
    for r in rows.orderBy("i").collect():
        text = given[r.i]
        found = {m.span() for p in (R.BRACKETED, R.TITLES, units, R.CUE_MARKERS, R.ELLIPSES, r"(?is)<([ibu])>.*?</\1>", "世", "b,") for m in re.finditer(p, text)}
        found |= {m.span() for m in re.finditer("「[^「」]*」", text) if m.start() > 0 and m.end() < len(text) and m.end() - m.start() <= 16}
        assert {(s.start, s.end) for s in r.spans} == found, text
        for p, got in enumerate(r.out):
            # Two spans that only touch leave a place between them.
            around = [s for s in found if s[0] < p < s[1]]
            covered = bool(around) or any(a[0] < p < b[1] and b[0] < a[1] for a in found for b in found if a[1] - a[0] > 1 and b[1] - b[0] > 1 and a[0] < p <= a[1] and b[0] < a[1] and b[0] <= p < b[1])
            assert got.inside == covered, (text, p)
            if not around:
                assert got.at == p
            else:
                assert got.at in {x for s in around for x in s}
        weights = [0.0] * len(text)
        for k, c in enumerate(text):
            weights[k] = 0.5 if c in "0123456789，,、；;。.!?！？：:…" else 1.0 if ord(c) > 127 and c.isalnum() else 0.0
        for m in re.finditer("[A-Za-z]+(?:['’][A-Za-z]+)*", text):
            weights[m.start() : m.end()] = [2.5 / (m.end() - m.start())] * (m.end() - m.start())
        assert r.w == pytest.approx(weights)


def one_cut(text, kind, expected):
    """The cut by looking at every position."""
    ends = lambda pattern: [p for p in G.sign_ends(pattern, text) if 0 < p < len(text) - 0 and p < len(text)]
    near = lambda places: min(places, key=lambda p: abs(p - expected), default=None)
    steps = []
    if kind:
        share, patterns = G.SIGNS[kind]
        steps.append((next((p for p in map(ends, patterns) if p), []), max(share * expected, 8), "original"))
    hard = max(0.25 * expected, 4)
    lefts = [m.start() for m in re.finditer(G.LEFT, text) if m.start()]
    steps.append((ends(G.STRONG) + lefts, max(0.15 * expected, 8) if kind else hard, "inferred"))
    steps.append((ends(G.WEAK), max(0.06 * expected, 3) if kind else hard, "inferred"))
    steps.append((ends(R.CLAUSE_SPACE), max(0.3 * expected, 4), "inferred"))
    blank = re.search(r"\s", text)
    steps.append(([m.end() for m in re.finditer(r"\s+" if blank else R.FALLBACK, text) if 0 < m.end() < len(text) and (m.start() > 0 or not blank)], float("inf"), None))
    for places, bound, tag in steps:
        at = near(places)
        if at is not None and abs(at - expected) <= bound:
            return at, tag
    return max(1, min(round(expected), len(text) - 2)), None


def test_single_cuts_against_all_positions(spark):
    """Texts without protected spans."""
    rnd = random.Random(2)
    given = [(t, rnd.choice([None, *G.SIGNS]), rnd.random() * len(t)) for t in some_texts(300, 3, ["a ", "b", "，", "。", ", ", ". ", "—", ": ", "「", "(", "世", "界 ", "你"]) if len(t) > 2]
    given = [(t, k, e) for t, k, e in given if not re.search(R.UNITS, t.replace("a", "").replace("b", "")) and ".." not in t and not re.search("[ab]{2}", t)]
    df = spark.createDataFrame([(i, *g) for i, g in enumerate(given)], "i int, t string, kind string, want double")
    c, none = F.col, F.array().cast(R.SPAN)
    rules = R.Rules(clause_spaces=True)
    found = R.facts(c("t"), none, none, rules)
    rows = df.withColumns({f"f_{k}": v for k, v in found.items()})
    f = {k: c(f"f_{k}") for k in found}
    request = F.array(F.struct("kind", c("want").alias("expected"), F.lit(None).cast("int").alias("anchor"), F.lit(None).cast("int").alias("marker"), (f["n"] - 1).alias("ceiling")))
    got = rows.withColumn("r", R.resolve(f, request, True)).orderBy("i").select("i", "r.cuts", "r.tags").collect()
    assert len(got) > 100
    for r in got:
        text, kind, want = given[r.i]
        # The last character is for the part after the cut.
        wanted = one_cut(text, kind, want)
        if wanted[0] < len(text) - 1:
            assert (r.cuts[0], r.tags[0]) == wanted, given[r.i]


def profile(text):
    depth = count = 0
    crossing = False
    for c in text:
        if c in checks.OPENERS:
            depth, count = depth + 1, count + 1
        elif c in checks.CLOSERS:
            depth, count = depth - 1, count + 1
            crossing, depth = crossing or depth < 0, max(depth, 0)
    return count, crossing or depth != 0


def best_edge(text, sources, cut):
    def mismatch(part, source):
        (a, x), (b, y) = profile(part), profile(source)
        return (0 if (a > 0) == (b > 0) else 1 if b else 0.5) + (0 if x == y else 0.5)

    places = [cut] + [k + (c in checks.CLOSERS) for k, c in enumerate(text) if c in checks.OPENERS + checks.CLOSERS]
    places = [p for p in places if 0 < p < len(text) or p == cut]
    return min(places, key=lambda p: abs(p - cut) / max(1, len(text)) + 0.25 * (mismatch(text[:p], sources[0]) + mismatch(text[p:], sources[1])))


def test_rebalance_brackets_and_signs(spark):
    rnd = random.Random(4)
    parts = ["a", "b ", "(", ")", "[", "]", "，", "x"]
    given = [("aa bb cc dd ee ff", [5.0, 5.0], [3], [None], ["", ""]), ("aa bb cc dd ee ff", [5.0, 5.0], [3], ["marker"], ["", ""]), ("aa bb, cc dd ee ff", [5.0, 5.0], [3], [None], ["", ""]), ("ab cd, ef", [1.0, 1.0], [5], [None], ["", ""]), ("ab cd, ef", [1.0, 1.0], [5], ["original"], ["", ""])]
    while len(given) < 200:
        text, pair = some_texts(1, rnd.random(), parts)[0], some_texts(2, rnd.random(), parts)
        if len(text) > 3 and any(profile(s)[0] for s in pair) and profile(text)[0]:
            given.append((text, [1.0, 1.0], [rnd.randrange(1, len(text))], [None], pair))
    df = spark.createDataFrame([(i, *g) for i, g in enumerate(given)], "i int, t string, l array<double>, cuts array<int>, tags array<string>, sources array<string>")
    c, none = F.col, F.array().cast(R.SPAN)
    found = R.facts(c("t"), none, none, R.Rules())
    rows = df.withColumns({f"f_{k}": v for k, v in found.items()})
    f = {k: c(f"f_{k}") for k in found}
    rows = rows.select("i", R.rebalance(f, c("l"), c("cuts"), c("tags")).alias("even"), R.align_to_brackets(c("t"), f, c("sources"), c("cuts"), c("tags")).alias("edge"), R.snap_forward(c("t"), f, c("cuts"), c("tags")).alias("snap"))
    got = {r.i: r for r in rows.collect()}
    assert [got[i].even for i in range(3)] == [[6], [3], [6]]
    assert [got[i].snap for i in (3, 4)] == [[6], [5]]
    for i in range(5, 200):
        text, _, cuts, _, pair = given[i]
        assert got[i].edge == [best_edge(text, pair, cuts[0])], given[i]


def squeezed(text):
    return re.sub(r"[\W_]+", "", text)


def test_units_lose_no_character(spark):
    """Whatever the text and the sources: as many parts as sources, and every letter and digit in one part. Signs that are
    alone in a part go when it is filled from its neighbour."""
    rnd = random.Random(6)
    plain = [x for x in SIGNS if "⟦" not in x]
    rows = [(t, [s or "…" for s in some_texts(rnd.choice([1, 2, 3, 5]), rnd.random(), plain)]) for t in some_texts(120, 7, plain)]
    rows += [(None, ["a", "b"]), ("", ["a"]), ("x", ["eins", "zwei", "drei"]), ("one two " * 60, ["eins zwei " * 20] * 3)]
    df = spark.createDataFrame([(i, t, s, [None] * len(s), 1) for i, (t, s) in enumerate(rows)], "i int, text string, sources array<string>, markers array<string>, parts int").drop("parts")
    got = {r.i: r for r in R.split_units(df).collect()}
    assert len(got) == len(rows)
    for i, (text, sources) in enumerate(rows):
        assert len(got[i].parts) == len(sources)
        assert squeezed("".join(got[i].parts)) == squeezed(text or ""), rows[i]


def test_units_by_hand(spark):
    rows = [
        ("Well, he came home. Then nothing", ["Nun,", "kam er heim.", "Dann nichts"], None, ["Well,", "he came home.", "Then nothing"], "original_boundary"),
        ("hello ⟦c12⟧ big world", ["hallo", "grosse welt"], [None, "12"], ["hello", "big world"], "marker_boundary"),
        ("你好，世界。我们走吧", ["Hello, world.", "Let's go"], None, ["你好，世界。", "我们走吧"], "original_boundary"),
        ("single ⟦c1⟧ text", ["x"], None, ["single text"], "single"),
        # A word is not cut, whichever part it is meant for.
        ("yes", ["ja", "..."], None, ["", "yes"], "word_boundary"),
        # A part without words gets some of its neighbour's.
        ("hello big world ⟦c3⟧ ?", ["hallo grosse", "welt ist da"], [None, "3"], ["hello", "big world?"], "marker_boundary"),
    ]
    df = spark.createDataFrame([(i, t, s, m or [None] * len(s)) for i, (t, s, m, _, _) in enumerate(rows)], "i int, text string, sources array<string>, markers array<string>")
    got = [(r.parts, r.method) for r in R.split_units(df).orderBy("i").collect()]
    assert got == [(parts, method) for *_, parts, method in rows]
    quoted = spark.createDataFrame([("「甲，乙」", ["a,", "b"], [None, None])], "text string, sources array<string>, markers array<string>")
    parts = R.split_units(quoted, R.Rules(quotes=("「", "」"))).first().parts
    assert all(p.count("「") == p.count("」") for p in parts)


def test_there_and_back(spark):
    """Cues to units, the units' own texts as translations, and back."""
    cues = [(1, 0, "- Hello there. - Hi", 0, 900), (1, 1, "I went to the", 1000, 1900), (1, 2, "market this morning,", 2000, 2900), (1, 3, "and came back.", 3000, 3900), (1, 4, "♪ la la ♪", 9000, 9900), (2, 0, None, 0, 500), (2, 1, "Alone.", 90_000, 91_000)]
    df = spark.createDataFrame(cues, "doc_id long, pos long, text string, start_ms long, end_ms long")
    units = R.marked_units(X.groups(X.merge_reasons(X.merge_sides(X.segments(df)))))
    split = R.split_units(units.withColumn("text", F.col("ask")))
    got = {(r.doc_id, r.pos): r.translation for r in R.restored_cues(df, split).collect()}
    assert len(got) == len(cues)
    assert got[1, 0].startswith("- Hello there.") and got[1, 0].endswith("- Hi")
    # The comma and the full stop are found again; between the first two cues there is no sign, so the shares decide.
    assert [got[1, k] for k in (1, 2, 3)] == ["I went to the market", "this morning,", "and came back."]
    assert got[1, 4] == "♪ la la ♪" and got[2, 1] == "Alone."
    lost = split.where("unit <> 1")
    assert R.restored_cues(df, lost).where("translation IS NULL").count() > 0


def test_each_unit_is_cut_once(spark):
    """Neither the look for empty parts nor their repair cuts a unit again that has none, however long it is."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = [(0, "well he came home", ["nun", "kam er heim"]), (1, "yes", ["ja", "..."]), (2, "hello ?", ["hallo", "welt"]), (3, "one two, " * 10_000, ["eins zwei, " * 5_000, "eins zwei " * 5_000])]
    df = spark.createDataFrame([(i, t, s, [None] * len(s)) for i, t, s in rows], "i int, text string, sources array<string>, markers array<string>")
    got = {r.i: r.parts for r in R.split_units(df.mapInPandas(counted, df.schema)).collect()}
    assert seen.value == len(rows)
    assert all(squeezed("".join(got[i])) == squeezed(t) for i, t, _ in rows)
    assert all(p.endswith("two,") for p in got[3])


def test_places_of_a_batch(spark):
    """Texts found together have the places that each has alone: nothing goes on from one to the next."""
    parts = [*SIGNS, "《", "》", "(", "【", "<i>", "</i>", "「", '"', "'", "\n", " ", "\t"]
    given = ["ends in 《", "》 begins", "(", ")", "a.", '"b', "5", "%", "", "x ", " y", *some_texts(200, 11, parts)]
    df = spark.createDataFrame(list(enumerate(given)), "i int, t string").coalesce(1)
    rules = R.Rules(quotes=("「", "」"), clause_spaces=True)
    rows = df.select("i", R.facts_at_once(F.col("t"), F.lit(True), F.array(F.lit("b")), rules).alias("f")).orderBy("i").collect()
    for text, f in zip(given, (r.f for r in rows), strict=True):
        inside = lambda p: any(s.start < p < s.end for s in f.spans)  # noqa: E731,B023
        found = lambda pattern: [m.span() for m in re.finditer(pattern, text, re.ASCII)]  # noqa: E731,B023
        ends = lambda pattern: [b for a, b in found(pattern) if not inside(b) and not (a and text[a - 1] in G.NO_LINE_END)]  # noqa: E731,B023
        quotes = [(a, b) for a, b in found("「[^「」]*」") if a > 0 and b < len(text) and b - a <= 16]
        spans = [x for p in (R.BRACKETED, R.TITLES, R.STYLED, R.UNITS, R.CUE_MARKERS, R.ELLIPSES) for x in found(p)] + quotes + found("b")
        assert [(s.start, s.end) for s in f.spans] == spans, text
        places = range(len(text) + 1)
        assert [p for p in places if any(s.start < p < s.end for s in f.protected)] == [p for p in places if inside(p)], text
        signs = {f"{kind}{i}": p for kind, (_, patterns) in G.SIGNS.items() for i, p in enumerate(patterns)} | {"strong": G.STRONG, "weak": G.WEAK, "clauses": R.CLAUSE_SPACE}
        assert {name: f[name] for name in signs} == {name: ends(p) for name, p in signs.items()}, text
        assert f.lefts == [a for a, _ in found(G.LEFT) if not inside(a)], text
        assert f.breaks == [b for _, b in found(R.FALLBACK) if not inside(b)], text
        assert [tuple(b) for b in f.blanks] == [(a, b, not inside(b)) for a, b in found(r"\s+")], text
        assert len(f.upto) == len(text) and f.upto == sorted(f.upto)
