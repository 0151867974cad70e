"""Where a translation of several cues is cut: punctuation that the sources end with is looked for near the expected
places, first for all cuts together, then cut by cut. Texts are short units; each is cut on its own within Arrow batches,
nothing is shuffled."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.edges import NO_LINE_END

# Signs by kind of boundary, tolerances as shares of a part and in characters.
SIGNS = {
    "trail_off": (0.6, [r"\.{2,}|-{2,}|—+|…+"]), "comma": (0.3, ["[,，；;]+", "、+"]), "period": (0.25, [r"[.。!?！？]+['\"”’)\]」』]*"]), "colon": (0.25, ["[:：]+"]),
}
CLOSING = r"['\"”’)\]}》」』】〕＞〉»›]*"
STRONG, WEAK, LEFT = "[，,、；;。.!?！？：:]+" + CLOSING, r"(?:\.{2,}|—+|…+)" + CLOSING, r"[“「『（(\[{＜〈《【〔„‚«‹¿¡]"
NEAR, NEAR_WEAK, STRONG_SHARE, WEAK_SHARE, HARD_SHARE, HARD_NEAR = 8, 3, 0.15, 0.06, 0.25, 4


def boundary(text: Column) -> Column:
    """The kind of sign that ends the text: trail_off, comma, period, colon, or null."""
    text = F.regexp_replace(text, r"\s+$", "")
    kinds = {"trail_off": r"(?:—|…|\.\.|--)$", "comma": "[,，、]$", "period": r"[.。!?！？]['\"”’)\]」』]*$", "colon": "[:：]$"}
    return F.coalesce(*(F.when(text.rlike(pattern), kind) for kind, pattern in kinds.items()))


def sign_ends(pattern: str, text: str) -> list[int]:
    """Ends of signs, but for those right after an opening sign."""
    return [m.end() for m in re.finditer(pattern, text) if not (m.start() and text[m.start() - 1] in NO_LINE_END)]


def align(targets: list[float], tolerances: list[float], places: list[int]) -> dict[int, int]:
    """Target index -> place, in order on both sides: as many as can be within their tolerances, and of these the nearest."""
    if not targets or not places:
        return {}
    worth = max(tolerances) + 1
    at = np.asarray(places, dtype=float)
    best = np.zeros((len(targets) + 1, len(places) + 1))
    for i, (target, tolerance) in enumerate(zip(targets, tolerances, strict=True)):
        away = np.abs(at - target)
        taken = np.where(away <= tolerance, best[i, :-1] + worth - away, 0)
        best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], taken))
    found = {}
    i, j = len(targets), len(places)
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            found[i] = places[j]
    return found


def anchors(text: str, kinds: list[str | None], expected: list[float]) -> dict[int, int]:
    """Cut index -> place, for cuts whose source ends with a kind of sign that the text has nearby."""
    found: dict[int, int] = {}
    for kind in dict.fromkeys(k for k in kinds if k):
        share, patterns = SIGNS[kind]
        used: set[int] = set()
        for pattern in patterns:
            left = [i for i, k in enumerate(kinds) if k == kind and i not in found]
            part = [expected[i] - (expected[i - 1] if i else 0) for i in left]
            places = [p for p in sign_ends(pattern, text) if p not in used]
            for k, place in align([expected[i] for i in left], [max(share * p, NEAR) for p in part], places).items():
                found[left[k]] = place
                used.add(place)
    return found


def resolve(text: str, cursor: int, expected: float, kind: str | None, anchor: int | None) -> tuple[int, str | None]:
    """One cut after cursor and how it was found: at the source's sign (original), at another sign (inferred), or between
    words (None)."""
    end = len(text)
    inside = lambda places: [p for p in places if cursor < p < end]
    if anchor is not None and cursor < anchor < end:
        return anchor, "original"
    part = max(expected - cursor, 0)
    steps = []
    if kind:
        share, patterns = SIGNS[kind]
        own = next((p for p in (inside(sign_ends(x, text)) for x in patterns) if p), [])
        steps.append((own, max(share * part, NEAR), "original"))
    hard = max(HARD_SHARE * part, HARD_NEAR)
    lefts = [m.start() for m in re.finditer(LEFT, text)]
    steps.append((inside(sign_ends(STRONG, text)) + inside(lefts), max(STRONG_SHARE * part, NEAR) if kind else hard, "inferred"))
    steps.append((inside(sign_ends(WEAK, text)), max(WEAK_SHARE * part, NEAR_WEAK) if kind else hard, "inferred"))
    words = [cursor + m.end() for m in re.finditer(r"\S+\s*" if re.search(r"\s", text[cursor:]) else r"[，,、；;。.!?…]+", text[cursor:])]
    steps.append((inside(words), float("inf"), None))
    for places, tolerance, tag in steps:
        nearest = min(places, key=lambda p: abs(p - expected), default=None)
        if nearest is not None and abs(nearest - expected) <= tolerance:
            return nearest, tag
    return max(cursor + 1, min(round(expected), end - 1)), None


def cut(text: str | None, kinds: list[str | None], expected: list[float]) -> list[tuple[int, str | None]]:
    """Cuts for the expected places, ascending. A text too short for more cuts ends with cuts at its end."""
    text = text or ""
    fixed = anchors(text, kinds, expected)
    cuts, cursor = [], 0
    for i, (kind, place) in enumerate(zip(kinds, expected, strict=True)):
        at, tag = resolve(text, cursor, place, kind, fixed.get(i)) if cursor < len(text) - 1 else (len(text), None)
        cuts.append((at, tag))
        cursor = at
    return cuts


def cut_translations(units: DataFrame, key: list[str]) -> DataFrame:
    """key, part, cut, tag for rows (key, text, kinds array<string>, expected array<double>, one entry for each cut)."""
    types = [f"{k} {units.schema[k].dataType.simpleString()}" for k in key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [
                (*own, part + 1, at, tag)
                for *own, text, kinds, expected in batch[[*key, "text", "kinds", "expected"]].itertuples(index=False)
                for part, (at, tag) in enumerate(cut(text, list(kinds), list(expected)))
            ]
            yield pd.DataFrame(found, columns=[*key, "part", "cut", "tag"])

    return units.select(*key, "text", "kinds", "expected").mapInPandas(run, ", ".join([*types, "part long", "cut long", "tag string"]))
