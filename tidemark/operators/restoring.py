"""From translated units back to cues: cuts of a translation for the segments of its unit, and cues put together again.

A unit is one row: its translation and the texts of its segments. The rules are column expressions over arrays of places
in the text (counted in code points, from 0), so nothing is shuffled until segments meet in their cue. Three small functions
run on Arrow batches, as a fold over places would copy what it has found at every step: where patterns match and which of
their ends lie inside a protected span, how many characters reach a weight, and the alignment of several expected cuts with
several signs (`merging.align`). Time grows with the length of a unit, not with its square.

A cut is never made inside a protected span (titles, styled text, numbers with units, words in Latin letters, markers,
ellipses, short quotes, brackets, terms of a glossary), unless the text offers nothing else.

Steps for a unit: expected places by weight; anchors at markers and at the signs that the sources end with; each cut by
`resolve`; parts far from their share of the weight `rebalance`d; cuts moved to brackets where the sources have them
(`align_to_brackets`); to a sign right behind (`snap_forward`); text cut, signs placed, and empty parts filled from their
neighbour (`repair_empty`).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tidemark.functions import checks, numbers
from tidemark.functions import edges as E
from tidemark.functions import text as T
from tidemark.operators import merging as G
from tidemark.operators.pieces import BATCH_BYTES, listed
from tidemark.sources.files import shared_folder

# Patterns of protected spans, bounds of shares, costs of brackets, tolerances.
LATIN = "A-Za-z\\u00C0-\\u00D6\\u00D8-\\u00F6\\u00F8-\\u024F"
COUNTERS = "个個名位年月日号號点點时時分秒岁歲次遍回倍条條件只隻张張块塊元万萬亿億千百层層楼樓米斤度周天场場部辆輛双雙种種套份头頭台页頁集章课課期代世纪紀毛角美刀磅吨噸克升级級人つ円歳番本枚匹階冊杯"
UNITS = "|".join(
    [
        r"(?:[A-Za-z]\.){2,}",
        f"(?:[{LATIN}]|[0-9]+[{LATIN}])[{LATIN}0-9]*(?:['’&-][{LATIN}0-9]+)*",
        r"[$€£¥₩]\s?[0-9][0-9.,]*",
        rf"第?[0-9][0-9.,]*(?:[:·/\-–][0-9]+)*(?:\s?(?:%|‰|°[CF]?|℃|℉|[€£¥₩])|[{COUNTERS}])",
        r"[0-9]+(?:[.,:·/\-–][0-9]+)+",
        "第[0-9]+",
    ]
)
TITLES, STYLED, CUE_MARKERS, ELLIPSES = "《[^《》]*》", r"(?is)<([ibu])>.*?</\1>", r"(?i)⟦c[0-9]+(?:\.[0-9]+)?⟧", r"\.{2,}|…+"
BRACKETED = r"（[^（）]{0,38}）|\([^()]{0,38}\)|【[^【】]{0,38}】|\[[^\[\]]{0,38}\]|〔[^〔〕]{0,38}〕"
RESIDUAL = r"⟦[^⟦⟧]*⟧|⟦[a-zA-Z]?[0-9]{0,6}(?:\.[0-9]+)?|⟧"
CLAUSE_SPACE, BLANKS, BREAKS = r"(?<![A-Za-z0-9])\s+(?![A-Za-z0-9\s])", " \t\n\v\f\r", "，,、；;。.!?…"
FALLBACK = rf"[{BREAKS}\s]+"
LONGEST_QUOTE, LATIN_WORD, DIGIT, SIGN = 16, 2.5, 0.5, 0.5
LOW_SHARE, HIGH_SHARE, SNAP_SHARE, SNAP_NEAR, FORWARD = 0.55, 1.85, 0.12, 3, 3
MISSING_BRACKET, EXTRA_BRACKET, UNBALANCED, MISMATCH = 1.0, 0.5, 0.5, 0.25
CLAUSE_SHARE, CLAUSE_NEAR = 0.3, 4

SPAN = "array<struct<start:int,end:int>>"
#: Ends by kind of sign, blanks (free: a cut may be at the end), ends between words of texts without blanks, sums of weights.
KINDS = [f"{kind}{i}" for kind, (_, patterns) in G.SIGNS.items() for i in range(len(patterns))]
NAMES = (*KINDS, "strong", "weak", "clauses", "lefts", "breaks", "blanks", "upto")
PLACES = f"{','.join(f'{name}:array<int>' for name in NAMES[:-2])},blanks:array<struct<start:int,end:int,free:boolean>>,upto:array<double>"
#: What the rules look up in a text, by name.
Facts = dict[str, Column]


@dataclass(frozen=True)
class Rules:
    """Of the target language. quotes: its pair, closed in every part; clause_spaces: blanks part clauses."""

    quotes: tuple[str, str] | None = None
    clause_spaces: bool = False
    anchors: bool = True


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def whole(value: Column) -> Column:
    return value.cast("int")


def span(start: Column, end: Column) -> Column:
    return F.struct(whole(start).alias("start"), whole(end).alias("end"))


def match_spans(text: Column, pattern: str | Column) -> Column:
    """Where the pattern matches, as an array of start and end."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    marked = F.regexp_replace(F.translate(text, "\u0001\u0002", "  "), F.concat(F.lit("("), pattern, F.lit(")")), F.lit("\u0001$1\u0002"))
    pieces = F.transform(F.split(marked, "[\u0001\u0002]"), lambda x, i: F.struct(F.length(x).alias("n"), (i % 2 == 1).alias("hit")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found"))

    def step(s: Column, x: Column) -> Column:
        end = s["at"] + x["n"]
        return F.struct(end.alias("at"), F.when(x["hit"], F.concat(s["found"], F.array(span(s["at"], end)))).otherwise(s["found"]).alias("found"))

    return F.aggregate(pieces, start, step)["found"]


class Laid:
    """Texts of a batch laid one after the other, so that a pattern runs over all of them at once. Between two there is a
    character that no pattern over signs, words or blanks takes in."""

    def __init__(self, texts: pa.Array):
        self.texts = [(t or "").replace("\u0001", " ").replace("\u0002", " ") for t in texts.to_pylist()]
        sizes = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.all, self.base, self.like = "\0" + "\0".join(self.texts) + "\0", np.cumsum(sizes + 1) - sizes, texts
        # Of no class of signs, words or blanks are characters beyond the first plane.
        self.codes = np.minimum(np.frombuffer(self.all.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 0xFFFF)

    def spans(self, pattern: str) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends. As in Java, blanks and cases are ASCII's."""
        at = np.array([m.span() for m in re.compile(pattern, re.ASCII).finditer(self.all)], dtype=np.int64).reshape(-1, 2)
        return at[:, 0], at[:, 1]

    def sign_spans(self, pattern: str) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of a pattern that takes in only characters it names: it is looked for in stretches of these."""
        at = np.flatnonzero(self.among(pattern))
        apart = np.flatnonzero(np.diff(at) > 1) + 1
        stretches, place = np.insert(self.codes[at], apart, 0).tobytes().decode("utf-32-le"), np.insert(at, apart, 0)
        found = np.array([m.span() for m in re.finditer(pattern, stretches)], dtype=np.int64).reshape(-1, 2)
        return place[found[:, 0]], place[found[:, 1] - 1] + 1

    def not_after(self, chars: str, start: np.ndarray) -> np.ndarray:
        return ~self.among(chars)[start - 1]

    def among(self, chars: str) -> np.ndarray:
        table = np.zeros(0x10000, dtype=bool)
        table[[ord(c) for c in chars]] = True
        return table[self.codes]

    def spans_within(self, pattern: str, sign: str, rows: Iterable[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of a pattern that has the sign and may take in any character, in some of the texts or all."""
        match, base = re.compile(pattern, re.ASCII).finditer, self.base.tolist()
        rows = range(len(base)) if rows is None else rows
        at = np.array([(m.start() + base[i], m.end() + base[i]) for i in rows if sign in self.texts[i] for m in match(self.texts[i])], dtype=np.int64).reshape(-1, 2)
        return at[:, 0], at[:, 1]

    def row(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, at, side="right") - 1

    def lists(self, row: np.ndarray, *at: np.ndarray, **more: np.ndarray) -> pa.Array:
        """Lists by row, which ascends: of places, or of structs of two places (start, end) and more."""
        own = [pa.array(x - self.base[row], pa.int32()) for x in at]
        items = own[0] if len(own) == 1 else pa.StructArray.from_arrays([*own, *map(pa.array, more.values())], ["start", "end", *more])
        return listed(self.like, items, np.bincount(row, minlength=len(self.base)))


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs; neither the first nor the last is inside."""
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return edges[::2], edges[1::2]


def spans_in(laid: Laid, brackets: pa.Array, terms: pa.Array, quoted: str | None) -> pa.Array:
    found = [laid.spans_within(BRACKETED, "", [i for i, x in enumerate(brackets.to_pylist()) if x]), laid.spans_within(TITLES, "《"), laid.spans_within(STYLED, "<")]
    found += map(laid.spans, (UNITS, CUE_MARKERS, ELLIPSES))
    if quoted:
        start, end = laid.spans_within(quoted, "")
        row = laid.row(start)
        size = np.array([len(t) for t in laid.texts], dtype=np.int64)
        short = (start > laid.base[row]) & (end < laid.base[row] + size[row]) & (end - start <= LONGEST_QUOTE)
        found.append((start[short], end[short]))
    known = [(m.start() + b, m.end() + b) for t, b, some in zip(laid.texts, laid.base.tolist(), terms.to_pylist(), strict=True) for term in some or () if term for m in re.finditer(re.escape(term), t)]
    found.append(tuple(np.array(known, dtype=np.int64).reshape(-1, 2).T))
    start, end = (np.concatenate(x) for x in zip(*found, strict=True))
    row = laid.row(start)
    order = np.argsort(row, kind="stable")
    return laid.lists(row[order], start[order], end[order])


def laid_spans(spans: pa.Array, base: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of spans on texts laid out from base on, or as wide as their spans need; and base."""
    sizes = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    start, end = (spans.flatten().field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
    if base is None:
        widest = np.zeros(len(sizes), dtype=np.int64)
        np.maximum.at(widest, row, end)
        base = np.cumsum(widest + 1) - widest
    return row, start + base[row], end + base[row], base


def islands_in(spans: pa.Array) -> pa.Array:
    row, start, end, base = laid_spans(spans)
    order = np.lexsort((end, start))
    order = order[(end - start)[order] > 1]
    row, start, end = row[order], start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.append(True, start[1:] >= end[:-1])[: len(start)])
    last = np.append(first[1:] - 1, len(start) - 1)[: len(first)]
    row = row[first]
    own = [pa.array(x - base[row], pa.int32()) for x in (start[first], end[last])]
    return listed(spans, pa.StructArray.from_arrays(own, ["start", "end"]), np.bincount(row, minlength=len(spans)))


def places_in(laid: Laid, protected: pa.Array, weights: pa.Array, clause_spaces: bool) -> dict[str, pa.Array]:
    _, start, end, _ = laid_spans(protected, laid.base)
    # Before all others there is a span without an inside.
    start, end = np.append(-1, start), np.append(-1, end)
    free = lambda at: at >= end[np.searchsorted(start, at) - 1]
    kept = lambda at, row: laid.lists(row[free(at)], at[free(at)])

    def ends(low: np.ndarray, high: np.ndarray) -> pa.Array:
        own = laid.not_after(E.NO_LINE_END, low)
        return kept(high[own], laid.row(low[own]))

    signs = {f"{kind}{i}": p for kind, (_, patterns) in G.SIGNS.items() for i, p in enumerate(patterns)} | {"strong": G.STRONG, "weak": G.WEAK}
    out = {name: ends(*laid.sign_spans(p)) for name, p in signs.items()}
    out["clauses"] = ends(*laid.spans(CLAUSE_SPACE if clause_spaces else "(?!)"))
    lefts, _ = laid.sign_spans(G.LEFT)
    low, high = runs(laid.among(BREAKS + BLANKS))
    out |= {"lefts": kept(lefts, laid.row(lefts)), "breaks": kept(high, laid.row(low))}
    low, high = runs(laid.among(BLANKS))
    out["blanks"] = laid.lists(laid.row(low), low, high, free=free(high))
    at, own = weights.offsets.to_numpy(), weights.values.to_numpy()
    sums = [np.cumsum(own[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    return out | {"upto": listed(laid.like, pa.array(np.concatenate([*sums, np.zeros(0)])), np.diff(at))}


def quoted(rules: Rules) -> str | None:
    if not rules.quotes:
        return None
    a, b = (E.char_class(q) for q in rules.quotes)
    return f"{a}[^{a[1:-1]}{b[1:-1]}]*{b}"


def protected_spans(text: Column, rules: Rules, brackets: Column, terms: Column | None = None) -> Column:
    """Spans that a cut should not divide. brackets: are bracketed texts among them?"""
    pattern = quoted(rules)
    find = F.arrow_udf(lambda texts, brackets, terms: spans_in(Laid(texts), brackets, terms, pattern), SPAN)
    return find(text, brackets, F.array().cast("array<string>") if terms is None else terms)


def islands(spans: Column) -> Column:
    """Spans of more than one character, overlapping ones put together, in order."""
    return F.arrow_udf(lambda spans: islands_in(spans), SPAN)(spans)


def inside(protected: Column, place: Column) -> Column:
    return F.exists(protected, lambda s: (s["start"] < place) & (place < s["end"]))


def escape(spans: Column, place: Column) -> Column:
    """The nearer end of the first span around the place, or the place."""
    around = F.get(F.filter(spans, lambda s: (s["start"] < place) & (place < s["end"])), F.lit(0))
    return F.coalesce(F.when(place - around["start"] <= around["end"] - place, around["start"]).otherwise(around["end"]), place)


def weight_kinds(text: Column) -> Column:
    """The text with other letters than ASCII's, digits and signs as one character each."""
    digits, signs = "0123456789", "，,、；;。.!?！？：:…"
    plain = F.translate(text, "\u0003\u0004\u0005" + digits + signs, "   " + "\u0003" * len(digits) + "\u0004" * len(signs))
    return F.regexp_replace(plain, r"[[^\x00-\x7F]&&[\p{L}\p{N}]]", "\u0005")


def weights_in(kinds: pa.Array) -> pa.Array:
    laid = Laid(kinds)
    letters, joints = laid.among("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), laid.among("'’")
    # A word goes on over an apostrophe that has letters on both sides.
    letters[1:-1] |= joints[1:-1] & letters[:-2] & letters[2:]
    found = laid.among("\u0003") * DIGIT + laid.among("\u0004") * SIGN + laid.among("\u0005") * 1.0
    start, end = runs(letters)
    found[letters] = np.repeat(LATIN_WORD / (end - start), end - start)
    sizes = np.array([len(t) for t in laid.texts], dtype=np.int64)
    within = np.ones(len(found), dtype=bool)
    within[[0, *(laid.base + sizes)]] = False
    return listed(kinds, pa.array(found[within]), sizes)


def weights(text: Column) -> Column:
    """The weight of each character: 2.5 to a word in ASCII letters, 0.5 to a digit or sign, 1 to other letters."""
    return F.arrow_udf(lambda kinds: weights_in(kinds), "array<double>")(weight_kinds(text))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def weight_until(f: Facts, place: Column) -> Column:
    return F.coalesce(F.get(f["upto"], place - 1), F.lit(0.0))


def weight_between(f: Facts, start: Column, end: Column) -> Column:
    return F.when(start < end, weight_until(f, end) - weight_until(f, start)).otherwise(0.0)


def all_weight(f: Facts) -> Column:
    return F.coalesce(F.try_element_at(f["upto"], F.lit(-1)), F.lit(0.0))


@F.arrow_udf(ArrayType(IntegerType()))
def places_of_weights(upto: pa.Array, targets: pa.Array) -> pa.Array:
    """For each target how many characters can be taken before their weight reaches it."""
    found = [np.searchsorted(u.values.to_numpy(), t.values.to_numpy(zero_copy_only=False)) if u.is_valid and t.is_valid else np.zeros(0, dtype=np.int64) for u, t in zip(upto, targets, strict=True)]
    return listed(targets, pa.array(np.concatenate([*found, np.zeros(0, dtype=np.int64)]), pa.int32()), np.array([len(x) for x in found], dtype=np.int64))


def facts(text: Column, spans: Column, protected: Column, rules: Rules) -> Facts:
    """Length, weights, protected spans, and the places where signs and blanks end. protected: what islands gives."""
    clauses = rules.clause_spaces

    def find(texts: pa.Array, protected: pa.Array, kinds: pa.Array) -> pa.Array:
        out = places_in(Laid(texts), protected, weights_in(kinds), clauses)
        return pa.StructArray.from_arrays(list(out.values()), list(out))

    at = F.arrow_udf(find, f"struct<{PLACES}>")(text, protected, weight_kinds(text))
    return {"spans": spans, "protected": protected, "n": F.length(text)} | {name: at[name] for name in NAMES}


def facts_at_once(text: Column, brackets: Column, terms: Column | None, rules: Rules) -> Column:
    """A struct of protected_spans, islands and facts but for n, found on one batch."""
    clauses, pattern = rules.clause_spaces, quoted(rules)

    def find(texts: pa.Array, brackets: pa.Array, terms: pa.Array, kinds: pa.Array) -> pa.Array:
        laid = Laid(texts)
        spans = spans_in(laid, brackets, terms, pattern)
        protected = islands_in(spans)
        out = {"spans": spans, "protected": protected} | places_in(laid, protected, weights_in(kinds), clauses)
        return pa.StructArray.from_arrays(list(out.values()), list(out))

    return F.arrow_udf(find, f"struct<spans:{SPAN},protected:{SPAN},{PLACES}>")(text, brackets, F.array().cast("array<string>") if terms is None else terms, weight_kinds(text))


def words_between(f: Facts, low: Column, high: Column, until: Column) -> Column:
    """Places between words after low and before high, by blanks if there are any before until, else by signs."""
    spaces = F.filter(f["blanks"], lambda s: s["free"] & (s["start"] > low) & (s["end"] < high))
    blank = F.exists(f["blanks"], lambda s: (s["end"] > low) & (s["start"] < until))
    return F.when(blank, F.transform(spaces, lambda s: s["end"])).otherwise(F.filter(f["breaks"], lambda x: (low < x) & (x < high)))


def shares(lengths: Column) -> Column:
    """For each cut the part of all lengths before it."""
    sum_ = F.greatest(total(lengths), F.lit(0.0))
    return F.transform(F.slice(lengths, 1, F.size(lengths) - 1), lambda x, i: total(F.slice(lengths, 1, i + 1)) / F.when(sum_ == 0, 1.0).otherwise(sum_))


def expected_places(f: Facts, lengths: Column) -> Column:
    """Where the cuts should be if the translation's weight were shared like the sources' lengths."""
    due = F.transform(shares(lengths), lambda s: F.struct(s.alias("share"), (all_weight(f) * s).alias("weight")))
    by_weight = lambda x, p: F.when(x["weight"] > 0, F.least(p, f["n"])).otherwise(0).cast("double")
    return F.zip_with(due, places_of_weights(f["upto"], F.transform(due, lambda x: x["weight"])), lambda x, p: F.when(all_weight(f) > 0, by_weight(x, p)).otherwise(f["n"] * x["share"]))


def refined_places(lengths: Column, anchors: Column, expected: Column, n: Column) -> Column:
    """Expected places between anchors, shared anew."""
    fixed = F.filter(F.transform(anchors, lambda a, i: F.struct(i.alias("i"), a.alias("at"))), lambda x: x["at"].isNotNull())

    def one(x: Column, i: Column) -> Column:
        low = F.coalesce(F.try_element_at(F.filter(fixed, lambda p: p["i"] < i), F.lit(-1)), F.struct(F.lit(-1).alias("i"), F.lit(0).alias("at")))
        high = F.coalesce(F.get(F.filter(fixed, lambda p: p["i"] > i), F.lit(0)), F.struct(F.size(expected).alias("i"), n.alias("at")))
        part = lambda end: total(F.slice(lengths, low["i"] + 2, end - low["i"]))
        moved = low["at"] + (high["at"] - low["at"]) * (part(i) / part(high["i"]))
        return F.when((F.size(fixed) == 0) | F.get(anchors, i).isNotNull() | (part(high["i"]) <= 0), x).otherwise(moved)

    return F.transform(expected, one)


def signs_between(f: Facts, kind: Column, low: Column, high: Column) -> Column:
    """Ends of the kind's signs: of the first of its patterns that has any."""
    between = lambda name: F.filter(f[name], lambda x: (low < x) & (x < high))
    out = F.array().cast("array<int>")
    for name, (_, patterns) in G.SIGNS.items():
        first = between(f"{name}0")
        out = F.when(kind == name, F.when(F.size(first) > 0, first).otherwise(between(f"{name}1")) if len(patterns) > 1 else first).otherwise(out)
    return out


def tolerance_of(kind: Column, part: Column) -> Column:
    share = F.coalesce(*(F.when(kind == name, F.lit(s)) for name, (s, _) in G.SIGNS.items()))
    return F.greatest(share * part, F.lit(float(G.NEAR)))


@F.pandas_udf(ArrayType(IntegerType()))
def aligned_anchors(kinds: pd.Series, expected: pd.Series, places: pd.Series) -> pd.Series:
    """For each cut the sign that the alignment gives it, or null. places: ends by pattern, in the order of SIGNS."""

    def one(kinds, expected, places):
        out = [None] * len(kinds)
        at = 0
        for name, (share, patterns) in G.SIGNS.items():
            for found in places[at : at + len(patterns)]:
                left = [i for i, kind in enumerate(kinds) if kind == name and out[i] is None]
                near = [max(share * (expected[i] - (expected[i - 1] if i else 0)), G.NEAR) for i in left]
                for k, place in G.align([expected[i] for i in left], near, list(found)).items():
                    out[left[k]] = place
            at += len(patterns)
        return out

    return pd.Series([one(*row) for row in zip(kinds, expected, places, strict=True)])


def resolve(f: Facts, requests: Column, use_clauses: bool) -> Column:
    """cuts and tags (how each was found) of requests (kind, expected, anchor, ceiling), one after the other: at the anchor,
    at the source's kind of sign, at any strong or weak sign, at a blank between clauses, between words, or anywhere."""

    def step(s: Column, r: Column) -> Column:
        low, want, kind = s["cursor"], r["expected"], r["kind"]
        high, part = F.least(f["n"], r["ceiling"]), F.greatest(want - low, F.lit(0.0))
        between = lambda *names: F.concat(*(F.filter(f[x], lambda p: (low < p) & (p < high)) for x in names))
        hard = F.greatest(G.HARD_SHARE * part, F.lit(float(G.HARD_NEAR)))
        bound = lambda share, near: F.when(kind.isNull(), hard).otherwise(F.greatest(share * part, F.lit(float(near))))
        ladder = [(signs_between(f, kind, low, high), tolerance_of(kind, part), "original"), (between("strong", "lefts"), bound(G.STRONG_SHARE, G.NEAR), "inferred"), (between("weak"), bound(G.WEAK_SHARE, G.NEAR_WEAK), "inferred")]
        if use_clauses:
            ladder.append((between("clauses"), F.greatest(CLAUSE_SHARE * part, F.lit(float(CLAUSE_NEAR))), "inferred"))
        ladder.append((words_between(f, low, high, f["n"]), F.lit(float("inf")), None))
        hit = lambda at, tag: F.struct(whole(at).alias("at"), F.lit(tag).cast("string").alias("tag"))
        steps = [F.when((low < r["anchor"]) & (r["anchor"] < high), hit(r["anchor"], "original"))]
        near_enough = lambda near, tag: lambda p: F.when(F.abs(p - want) <= near, hit(p, tag))
        steps += [let(numbers.nearest(places, want), near_enough(near, tag)) for places, near, tag in ladder]
        blind = whole(F.greatest(low + 1, F.least(numbers.round_half_even(want), high - 1)))
        found = F.coalesce(*steps, hit(escape(f["spans"], blind), None))
        marked = lambda x: F.when(r["marker"] == x["at"], "marker").otherwise(x["tag"])
        return let(found, lambda x: F.struct(x["at"].alias("cursor"), F.concat(s["cuts"], F.array(x["at"])).alias("cuts"), F.concat(s["tags"], F.array(marked(x))).alias("tags")))

    start = F.struct(F.lit(0).alias("cursor"), F.array().cast("array<int>").alias("cuts"), F.array().cast("array<string>").alias("tags"))
    return F.aggregate(requests, start, step)


def rebalance(f: Facts, lengths: Column, cuts: Column, tags: Column) -> Column:
    """Cuts beside parts whose share of the weight is far from their share of the lengths, set anew between the cuts around
    them, at a strong sign or a word's end near the place by weight. Cuts at markers stay."""
    n, locked = f["n"], lambda k: F.coalesce(F.get(tags, k) == "marker", F.lit(False))
    bounds = F.concat(F.array(F.lit(0)), cuts, F.array(n))
    sum_ = F.when(total(lengths) > 0, total(lengths)).otherwise(1.0)

    def off(x: Column, i: Column) -> Column:
        due = all_weight(f) * x / sum_
        ratio = F.when(due > 0, weight_between(f, F.get(bounds, i), F.get(bounds, i + 1)) / due).otherwise(1.0)
        return F.when((ratio < LOW_SHARE) | (ratio > HIGH_SHARE), i)

    bad = F.filter(F.transform(lengths, off), lambda x: x.isNotNull())

    def runs(done: Column, i: Column) -> Column:
        low, high, last = F.greatest(F.lit(0), i - 1), F.least(F.size(lengths) - 1, i + 1), F.try_element_at(done, F.lit(-1))
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(span(last["start"], F.greatest(last["end"], high))))
        return F.when((F.size(done) > 0) & (low <= last["end"] + 1), longer).otherwise(F.concat(done, F.array(span(low, high))))

    steps = F.flatten(F.transform(F.aggregate(bad, F.array().cast(SPAN), runs), lambda r: F.transform(F.sequence(r["start"], r["end"] - 1), lambda k: F.struct(k.alias("k"), r["start"].alias("low"), r["end"].alias("high")))))

    def step(s: Column, x: Column) -> Column:
        k, first, last = x["k"], F.get(bounds, x["low"]), F.get(bounds, x["high"] + 1)
        cursor = F.when(k == x["low"], first).otherwise(s["cursor"])
        part = F.slice(lengths, x["low"] + 1, x["high"] - x["low"] + 1)
        share = total(F.slice(part, 1, k - x["low"] + 1)) / F.when(total(part) > 0, total(part)).otherwise(1.0)
        target = weight_until(f, first) + weight_between(f, first, last) * share
        by_weight = let(target, lambda t: F.when(t > 0, F.least(F.size(F.filter(f["upto"], lambda u: u < t)), n)).otherwise(0))
        room = last - F.greatest(x["high"] - k, F.lit(1))
        ideal = F.greatest(cursor + 1, F.least(by_weight, room))
        near = F.greatest(SNAP_SHARE * (last - first) / (x["high"] - x["low"]), F.lit(float(SNAP_NEAR)))

        def snapped(ideal: Column) -> Column:
            signs = F.filter(f["strong"], lambda p: (cursor < p) & (p < last) & (F.abs(p - ideal) <= near))
            return F.coalesce(numbers.nearest(signs, ideal), numbers.nearest(words_between(f, cursor, last, last), ideal), escape(f["spans"], ideal))

        at = let(let(ideal, snapped), lambda p: whole(F.greatest(cursor + 1, F.least(p, room))))
        now = let(at, lambda p: F.when(locked(k) | inside(f["protected"], p), F.get(s["cuts"], k)).otherwise(p))
        return let(now, lambda p: F.struct(p.alias("cursor"), F.transform(s["cuts"], lambda c, j: F.when(j == k, p).otherwise(c)).alias("cuts")))

    moved = F.aggregate(steps, F.struct(F.lit(0).alias("cursor"), cuts.alias("cuts")), step)["cuts"]
    return F.when((F.size(lengths) > 1) & (all_weight(f) > 0), moved).otherwise(cuts)


def align_to_brackets(text: Column, f: Facts, sources: Column, cuts: Column, tags: Column) -> Column:
    """Cuts moved to the bracket edge where distance and what the parts' brackets lack of their sources' cost least."""
    bracket = checks.BRACKET
    edges = F.transform(match_spans(text, bracket), lambda s: F.when(F.substr(text, s["start"] + 1, F.lit(1)).rlike(f"[{checks.re.escape(checks.OPENERS)}]"), s["start"]).otherwise(s["end"]))

    def mismatch(part: Column, source: Column) -> Column:
        def cost(a: Column, b: Column) -> Column:
            presence = F.when((a["count"] > 0) == (b["count"] > 0), 0.0).when(b["count"] > 0, MISSING_BRACKET).otherwise(EXTRA_BRACKET)
            return presence + F.when(a["crossing"] == b["crossing"], 0.0).otherwise(UNBALANCED)

        return let(checks.bracket_profile(part), lambda a: let(checks.bracket_profile(source), lambda b: cost(a, b)))

    def step(done: Column, i: Column) -> Column:
        low, high, now = F.when(i == 0, 0).otherwise(F.get(done, i - 1)), F.when(i == F.size(cuts) - 1, f["n"]).otherwise(F.get(done, i + 1)), F.get(done, i)
        scale = F.greatest(F.lit(1), high - low)
        piece = lambda a, b: F.substr(text, a + 1, F.greatest(b - a, F.lit(0)))
        cost = lambda p: F.abs(p - F.get(cuts, i)) / scale + MISMATCH * (mismatch(piece(low, p), F.get(sources, i)) + mismatch(piece(p, high), F.get(sources, i + 1)))
        places = F.concat(F.array(now), F.filter(edges, lambda e: (low < e) & (e < high) & (e != now) & ~inside(f["protected"], e)))
        best = F.array_min(F.transform(places, lambda p, j: F.struct(cost(p).alias("cost"), j.alias("j"), p.alias("p"))))["p"]
        return F.when(F.coalesce(F.get(tags, i) == "marker", F.lit(False)), done).otherwise(F.transform(done, lambda c, j: F.when(j == i, best).otherwise(c)))

    wanted = (F.size(cuts) > 0) & text.rlike(bracket) & F.exists(sources, lambda s: s.rlike(bracket))
    return F.when(wanted, F.aggregate(F.transform(cuts, lambda c, i: i), cuts, step)).otherwise(cuts)


def snap_forward(text: Column, f: Facts, cuts: Column, tags: Column) -> Column:
    """Cuts moved behind a strong sign that begins within three characters after them."""

    def one(c: Column, i: Column) -> Column:
        end = F.least(c + FORWARD, F.coalesce(F.get(cuts, i + 1), f["n"]))
        found = F.transform(match_spans(F.substr(text, c + 1, F.greatest(end - c, F.lit(0))), G.STRONG), lambda s: s["end"] + c)
        return F.when(F.coalesce(F.get(tags, i), F.lit("")).isin("marker", "original"), c).otherwise(F.coalesce(F.array_min(F.filter(found, lambda x: ~inside(f["protected"], x))), c))

    return F.transform(cuts, one)


def cut_text(text: Column, cuts: Column) -> Column:
    bounds = F.concat(F.array(F.lit(0)), cuts, F.array(F.length(text)))
    return F.transform(F.slice(bounds, 1, F.size(bounds) - 1), lambda a, i: trim(F.substr(text, a + 1, F.greatest(F.get(bounds, i + 1) - a, F.lit(0)))))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def split_rows(rows: DataFrame, text: Column, sources: Column, markers: Column, guard: Column, rules: Rules, terms: Column | None) -> DataFrame:
    """rows with __parts and __tags: text (not null) cut for its sources. guard: may bracketed texts be protected?

    Each step is a column of its own, so that it is computed once.
    """
    c = F.col
    # For the session: a batch of long texts has many places.
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    named = {"__text": text, "__sources": sources, "__markers": markers}
    rows = rows.withColumns(named)
    rows = rows.withColumns({"__n": F.length("__text"), "__bracketed": c("__text").rlike(checks.BRACKET)})
    rows = rows.withColumn("__facts", facts_at_once(c("__text"), c("__bracketed") & guard, terms, rules))
    f = {name: c("__facts")[name] for name in ("spans", "protected", *NAMES)} | {"n": c("__n")}
    rows = rows.withColumn("__lengths", F.transform("__sources", lambda s: T.weighted_length(s).cast("double")))
    rows = rows.withColumns({"__expected": expected_places(f, c("__lengths")), "__kinds": F.transform(F.slice("__sources", 1, F.size("__sources") - 1), G.boundary)})
    at = lambda m: F.nullif(F.position(F.concat(F.lit("⟦c"), m, F.lit("⟧")), F.lower("__text")), F.lit(0)) - 1
    rows = rows.withColumn("__marked", F.transform(F.slice("__markers", 2, F.greatest(F.size("__markers") - 1, F.lit(0))), at))
    places = F.array(*(f[name] for name in KINDS))
    rows = rows.withColumn("__signs", aligned_anchors(c("__kinds"), c("__expected"), places) if rules.anchors else F.array().cast("array<int>"))
    rows = rows.withColumn("__fixed", F.transform("__expected", lambda x, i: F.coalesce(F.get(c("__marked"), i), F.get(c("__signs"), i))))
    rows = rows.withColumn("__refined", refined_places(c("__lengths"), c("__fixed"), c("__expected"), f["n"]))
    request = lambda x, i: F.struct(F.get(c("__kinds"), i).alias("kind"), x.alias("expected"), whole(F.get(c("__fixed"), i)).alias("anchor"), whole(F.get(c("__marked"), i)).alias("marker"), (f["n"] - (F.size("__sources") - 1 - i)).alias("ceiling"))
    rows = rows.withColumn("__found", resolve(f, F.transform("__refined", request), rules.clause_spaces)).withColumn("__tags", c("__found")["tags"])
    rows = rows.withColumn("__cuts", rebalance(f, c("__lengths"), c("__found")["cuts"], c("__tags")))
    rows = rows.withColumn("__cuts", F.when(c("__bracketed"), align_to_brackets(c("__text"), f, c("__sources"), c("__cuts"), c("__tags"))).otherwise(c("__cuts")))
    rows = rows.withColumn("__cuts", snap_forward(c("__text"), f, c("__cuts"), c("__tags")))
    rows = rows.withColumn("__parts", F.when(F.size("__sources") == 1, F.array(trim(c("__text")))).otherwise(cut_text(c("__text"), c("__cuts"))))
    return rows.drop(*named, "__facts", "__n", "__bracketed", "__lengths", "__expected", "__kinds", "__marked", "__signs", "__fixed", "__refined", "__found", "__cuts")


def has_content(text: Column) -> Column:
    return text.rlike(r"[\p{L}\p{N}_]")


def proportional_parts(text: Column, sources: Column) -> Column:
    """Two parts at the word's end nearest to the sources' shares, outside of titles, or null."""
    titles = match_spans(text, TITLES)
    blanks = F.transform(match_spans(text, r"\s+"), lambda s: s.withField("free", ~inside(titles, s["end"])))
    f = {"blanks": blanks, "breaks": F.filter(F.transform(match_spans(text, FALLBACK), lambda s: s["end"]), lambda x: ~inside(titles, x))}
    n = F.length(text)
    lengths = F.transform(sources, lambda s: T.weighted_length(s).cast("double"))
    want = let(n * F.get(shares(lengths), 0), numbers.round_half_even)
    at = let(words_between(f, F.lit(0), n, n), lambda inner: F.when(F.size(inner) > 0, numbers.nearest(F.concat(F.array(F.lit(0)), inner, F.array(n)), want)))
    return let(at, lambda x: F.when((x > 0) & (x < n), cut_text(text, F.array(x))))


def repair_empty(rows: DataFrame, guard: Column, rules: Rules, terms: Column | None) -> DataFrame:
    """rows (parts, sources): parts without content whose source has some share their neighbour's text, cut anew, else by
    proportion. Parts are looked at from left to right, one of each unit in a round; there are as many rounds as the
    unit with most of them needs. Each round is a table in the shared folder, and only units with such a part are in the
    next one, so that none is cut twice."""
    c, spark = F.col, rows.sparkSession
    folder = shared_folder(spark)
    empty = lambda p, i: ~has_content(p) & has_content(F.get(c("sources"), i)) & (F.size("parts") > 1) & (i > c("__seen"))
    at = F.array_min(F.transform("parts", lambda p, i: F.when(empty(p, i), i)))

    def write(rows: DataFrame, number: int) -> DataFrame:
        rows = rows.withColumn("__i", at)
        path = f"{folder}/round={number}"
        rows.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    rows = write(rows.withColumn("__seen", F.lit(-1)), 0)
    rounds = [rows.where("__i is null")]
    while not (rows := rows.where("__i is not null")).isEmpty():
        rows = rows.withColumn("__low", F.greatest(c("__i") - 1, F.lit(0)))
        rows = rows.withColumn("__near", F.coalesce(F.get("parts", F.when(c("__i") > 0, c("__i") - 1).otherwise(1)), F.lit("")))
        rows = rows.withColumn("__pair", F.slice("sources", c("__low") + 1, F.lit(2)))
        none = F.array(F.lit(None).cast("string"), F.lit(None).cast("string"))
        rows = split_rows(rows, c("__near"), c("__pair"), none, guard, rules, terms)
        filled = lambda p: has_content(F.coalesce(F.get(p, c("__i") - c("__low")), F.lit("")))
        rows = rows.withColumn("__share", proportional_parts(c("__near"), c("__pair")))
        rows = rows.withColumn("__new", F.when(filled(c("__parts")), c("__parts")).when(filled(c("__share")), c("__share")))
        put = F.transform("parts", lambda x, j: F.when(j == c("__low"), c("__new")[0]).when(j == c("__low") + 1, c("__new")[1]).otherwise(x))
        rows = rows.withColumns({"parts": F.when(c("__new").isNotNull(), put).otherwise(c("parts")), "__seen": c("__i")})
        rows = settled(rows.drop("__i", "__low", "__near", "__pair", "__parts", "__tags", "__share", "__new"))
        rows = write(rows, len(rounds))
        rounds.append(rows.where("__i is null"))
    return reduce(DataFrame.unionByName, rounds).drop("__seen", "__i")


def without_markers(text: Column) -> Column:
    rest = F.regexp_replace(F.regexp_replace(text, rf"\s+(?:{RESIDUAL})\s+", " "), RESIDUAL, "")
    return trim(F.when(text.contains("⟦") | text.contains("⟧"), rest).otherwise(text))


def close_quotes(parts: Column, quotes: tuple[str, str]) -> Column:
    """Each part with as many closing quotes as opening ones."""

    def one(part: Column) -> Column:
        opened, closed = (F.regexp_count(part, F.lit(E.char_class(q))) for q in quotes)
        return F.concat(F.repeat(F.lit(quotes[0]), F.greatest(closed - opened, F.lit(0))), part, F.repeat(F.lit(quotes[1]), F.greatest(opened - closed, F.lit(0))))

    return F.when(F.size(parts) > 1, F.transform(parts, one)).otherwise(parts)


def method_of(tags: Column) -> Column:
    has = lambda tag: F.exists(tags, lambda t: F.coalesce(t == tag, F.lit(False)))
    other = F.exists(tags, lambda t: F.coalesce(t != "marker", F.lit(False)))
    kinds = F.when(F.size(tags) == 0, "single").when(has("marker") & other, "mixed_boundary").when(has("marker"), "marker_boundary")
    return kinds.when(has("original"), "original_boundary").when(has("inferred"), "inferred_punctuation").otherwise("word_boundary")


def settled(rows: DataFrame) -> DataFrame:
    """rows as they are. Later filters stop here: pushed through all steps, their expressions would multiply."""
    return rows.mapInArrow(lambda batches: batches, rows.schema)


def split_units(units: DataFrame, rules: Rules | None = None, terms: str | None = None) -> DataFrame:
    """units (text, sources array<string>, markers array<string>: the id of the marker before each source, or null) with
    parts, one for each source, and method. terms names a column of glossary terms. A null text is empty."""
    rules = rules or Rules()
    c, known = F.col, F.col(terms) if terms else None
    guard = ~F.exists("sources", lambda s: s.rlike(checks.BRACKET) & checks.bracket_profile(s)["crossing"])
    rows = split_rows(units, F.coalesce("text", F.lit("")), c("sources"), c("markers"), guard, rules, known)
    rows = rows.withColumns({"parts": E.place_punctuation(F.transform("__parts", without_markers)), "method": method_of(c("__tags"))}).drop("__parts", "__tags")
    rows = repair_empty(settled(rows), guard, rules, known)
    return settled(rows.withColumn("parts", close_quotes(c("parts"), rules.quotes))) if rules.quotes else rows


def marked_units(segments: DataFrame) -> DataFrame:
    """doc_id, unit, sources, markers, cues, turns, music and ask (what to translate, with a marker before each segment that
    a mark joins) of segments (doc_id, pos, cue_id, turn, text, music, group, marked). Markers of one cue in one unit are
    numbered .1, .2 where there are several."""
    per = F.row_number().over(W.partitionBy("doc_id", "group", "cue_id", "marked").orderBy("pos"))
    several = F.count("*").over(W.partitionBy("doc_id", "group", "cue_id", "marked")) > 1
    marker = F.when(F.col("marked"), F.concat(F.col("cue_id").cast("string"), F.when(several, F.concat(F.lit("."), per)).otherwise("")))
    # Dealt out by unit once; the windows lie within units.
    rows = segments.repartition("doc_id", "group").withColumn("__marker", marker)
    part = F.struct("pos", F.coalesce("text", F.lit("")).alias("text"), F.col("__marker").alias("marker"), "cue_id", "turn", "music")
    units = rows.groupBy("doc_id", "group").agg(F.array_sort(F.collect_list(part)).alias("__s"))
    tagged = F.transform("__s", lambda s: F.when(s["marker"].isNull(), s["text"]).otherwise(F.concat(F.lit("⟦c"), s["marker"], F.lit("⟧"), s["text"])))
    names = {"sources": "text", "markers": "marker", "cues": "cue_id", "turns": "turn"}
    return units.select("doc_id", F.col("group").alias("unit"), *(F.col(f"__s.{field}").alias(name) for name, field in names.items()), F.exists("__s", lambda s: s["music"]).alias("music"), F.btrim(F.array_join(tagged, " ")).alias("ask"))


def restored_cues(cues: DataFrame, split: DataFrame) -> DataFrame:
    """doc_id, pos, text, translation: cues (doc_id, pos, text) with the parts (doc_id, cues, turns, parts) of their units. Of
    several turns each has a dash, in the way of most of the document's dashed lines; a cue that lacks a part has no
    translation, and neither has one without parts."""
    c = F.col
    parts = split.select("doc_id", F.explode(F.arrays_zip("cues", "turns", "parts")).alias("p")).select("doc_id", c("p.cues").alias("pos"), c("p.turns").alias("turn"), c("p.parts").alias("part"))
    held = parts.groupBy("doc_id", "pos").agg(F.array_sort(F.collect_list(F.struct("turn", "part"))).alias("said"))
    lines = cues.select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")).select("doc_id", trim(F.regexp_replace("line", T.STYLE_TAG, "")).alias("line")).where("line LIKE '-%'")
    spaced = F.avg(F.when(c("line").startswith("- "), 1.0).otherwise(0.0))
    style = lines.groupBy("doc_id").agg(F.when(spaced >= 2 / 3, "- ").otherwise("-").alias("dash"))
    # Cues get what is known of their documents and texts first: a text is shuffled only if it is asked for, and parts once.
    known = cues.select("doc_id", "pos", "text", F.size(E.turns(F.coalesce("text", F.lit("")))).alias("turns")).join(style, "doc_id", "left")
    dashed = F.transform("said", lambda s: F.concat(F.coalesce("dash", F.lit("-")), F.regexp_replace(s["part"], "^[- ]+", "")))
    whole_ = (F.size("said") >= c("turns")) & ~F.exists("said", lambda s: s["part"].isNull())
    said = F.when(whole_, F.when(F.size("said") > 1, F.array_join(dashed, " ")).otherwise(c("said")[0]["part"]))
    return known.join(held, ["doc_id", "pos"], "left").select("doc_id", "pos", "text", said.alias("translation"))
