"""Checks and repairs of translated text, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import MUSIC, join_lines

# Markers, bracket pairs, punctuation of the two widths, quote pairs.
MARKER = r"⟦/?[a-z]?\d*⟧"
BRACKETS = (("(", ")"), ("[", "]"), ("{", "}"), ("（", "）"), ("【", "】"))
OPENERS, CLOSERS = "([{（［｛〔〖〘〚〈《【⟨⟪", ")]}）］｝〕〗〙〛〉》】⟩⟫"
#: A class of both, in ranges, which are quicker to test than each of them.
BRACKET = r"[()\[\]{}⟨-⟫〈-》【】〔-〛（）［］｛｝]"
HALF_WIDTH, FULL_WIDTH = ",.!?:;()", "，。！？：；（）"
QUOTES = (("“", "”"), ("‘", "’"), ("«", "»"), ("「", "」"), ("『", "』"), ("„", "“"))
#: Script names, whether words are written with spaces, and how long a run must be to tell.
LEAK_RUNS = {"Han": 2, "Hiragana": 1, "Katakana": 1, "Hangul": 2, "Cyrillic": 2, "Arabic": 2, "Hebrew": 2, "Thai": 2, "Greek": 2}


def normalise_markers(text: Column) -> Column:
    """White space inside markers goes; brackets of other widths become ⟦ and ⟧."""
    wide = F.regexp_replace(F.regexp_replace(text, r"[〚\[]{2}\s*(?=/?[a-z]?\d*\s*[〛\]]{2})", "⟦"), r"(?<=⟦/?[a-z]?\d{0,9})\s*[〛\]]{2}", "⟧")
    return F.regexp_replace(wide, r"⟦\s*(/?[a-z]?\d*)\s*⟧", "⟦$1⟧")


def strip_markers(text: Column) -> Column:
    return join_lines(F.regexp_replace(text, MARKER, ""))


def corrupt_markers(text: Column) -> Column:
    """Is there a marker bracket that belongs to no marker?"""
    return F.regexp_replace(text, MARKER, "").rlike("[⟦⟧]")


def bracket_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(BRACKET))


def bracket_profile(text: Column) -> Column:
    """count: brackets of any kind; crossing: one closes that none has opened, or one stays open."""
    kept = F.regexp_replace(text, f"[^{BRACKET[1:-1]}]+", "")
    steps = F.transform(F.filter(F.split(kept, ""), lambda c: c != ""), lambda c: F.when(F.position(c, F.lit(OPENERS)) > 0, 1).otherwise(-1))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("crossing"))

    def step(s: Column, x: Column) -> Column:
        depth = s["depth"] + x
        return F.struct(F.greatest(depth, F.lit(0)).alias("depth"), (s["crossing"] | (depth < 0)).alias("crossing"))

    return F.struct(F.length(kept).alias("count"), F.aggregate(steps, start, step, lambda s: s["crossing"] | (s["depth"] > 0)).alias("crossing"))


def marker_leak(text: Column, source: Column) -> Column:
    """Does the text have more brackets than its source, once markers are taken out?"""
    return bracket_count(F.regexp_replace(text, MARKER, "")) > bracket_count(F.regexp_replace(source, MARKER, ""))


def unbalanced_brackets(text: Column) -> Column:
    """Is a bracket left over when each closing one takes back the last opening one, which must be of its kind?"""
    kept = F.regexp_replace(text, f"[^{BRACKET[1:-1]}]+", "")

    def step(stack: Column, c: Column) -> Column:
        kind, top = F.position(c, F.lit(CLOSERS)), F.position(F.right(stack, F.lit(1)), F.lit(OPENERS))
        pops = (F.length(stack) > 0) & (kind == top)
        return F.when(stack == "!", stack).when(kind == 0, F.concat(stack, c)).when(pops, F.left(stack, F.length(stack) - 1)).otherwise("!")

    return F.aggregate(F.filter(F.split(kept, ""), lambda c: c != ""), F.lit(""), step) != ""


def source_script_words(text: Column, script: str) -> Column:
    return F.regexp_count(text, F.lit(rf"[\p{{Is{script}}}]{{{LEAK_RUNS.get(script, 2)},}}"))


def untranslated(text: Column, script: str, allowance: int = 2) -> Column:
    """Are there more words left in the source's script than allowed?"""
    return source_script_words(text, script) > allowance


def full_width(text: Column) -> Column:
    """Punctuation after CJK letters at full width."""
    out = text
    for a, b in zip(HALF_WIDTH, FULL_WIDTH, strict=True):
        out = F.regexp_replace(out, rf"(?<=[\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}])\{a}\s?", b)
    return out


def half_width(text: Column) -> Column:
    return F.translate(text, FULL_WIDTH, HALF_WIDTH)


def drop_terminators(text: Column) -> Column:
    """Full stops at the ends of lines go, as CJK subtitles have it; ellipses stay."""
    return F.regexp_replace(text, r"(?m)(?<![.。])[.。，,](?=\s*$)", "")


def balance_quotes(text: Column, source: Column) -> Column:
    """Quotes go where the source has none; a pair that lacks a side gets it at the end or the beginning."""
    has_quotes = source.rlike("[\"“”„«»「」『』]")
    out = F.when(has_quotes, text).otherwise(F.regexp_replace(text, "[“”„«»「」『』]", ""))
    for a, b in QUOTES[:1] + QUOTES[2:5]:
        opened, closed = F.regexp_count(out, F.lit(a)), F.regexp_count(out, F.lit(b))
        out = F.when(opened > closed, F.concat(out, F.lit(b))).when(closed > opened, F.concat(F.lit(a), out)).otherwise(out)
    return out


def quote_open(text: Column) -> Column:
    """Does the text end inside a straight or paired quote?"""
    straight = F.regexp_count(text, F.lit('"')) % 2 == 1
    paired = F.lit(False)
    for a, b in QUOTES[:1] + QUOTES[2:5]:
        paired |= F.regexp_count(text, F.lit(a)) > F.regexp_count(text, F.lit(b))
    return straight | paired


def edge_flags(text: Column) -> Column:
    """Bits: 1 ends a sentence, 2 ends open (comma or dash), 4 ends in an ellipsis, 8 begins in lower case, 16 begins with
    a dash, 32 begins with an ellipsis, 64 has music, 128 ends inside a quote."""
    tests = (
        text.rlike(r"[.!?。！？][\"'”’»)\]]*\s*$"), text.rlike(r"[,，、;；:：—–-]\s*$"), text.rlike(r"(?:…|\.{3})[\"'”’»)\]]*\s*$"),
        F.regexp_extract(text, r"\p{L}", 0).rlike(r"\p{Ll}"), text.rlike(r"^\s*[-–—]"), text.rlike(r"^\s*(?:…|\.{3})"), text.rlike(f"[{MUSIC}]"), quote_open(text),
    )
    out = F.lit(0)
    for i, test in enumerate(tests):
        out = out + F.when(test, 1 << i).otherwise(0)
    return out


def presentable(text: Column, source: Column, script: str) -> Column:
    from tidemark.functions.text import plausible_length

    return ~(untranslated(text, script) | marker_leak(text, source) | corrupt_markers(text)) & plausible_length(source, text)


def format_tokens(text: Column) -> Column:
    """Style tags as marker tokens: `<b>` to `⟦b⟧`, without white space inside the pair."""
    opened = F.regexp_replace(text, r"<(i|b|u)>\s*", "⟦$1⟧")
    return F.regexp_replace(opened, r"\s*</(i|b|u)>", "⟦/$1⟧")


def format_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"⟦(/?[ibu])⟧", "<$1>")


def traditional_votes(text: Column) -> Column:
    """Characters of traditional less those of simplified Chinese, of a fixed list of common pairs."""
    traditional, simplified = "們這來說時個為國對會過還學見開發東車長門問間馬", "们这来说时个为国对会过还学见开发东车长门问间马"
    return F.regexp_count(text, F.lit(f"[{traditional}]")) - F.regexp_count(text, F.lit(f"[{simplified}]"))


def retry_delay(attempt: Column, first_ms: int = 5_000, most_ms: int = 60_000) -> Column:
    """Doubling with a cap."""
    return F.least(F.lit(most_ms), first_ms * F.pow(F.lit(2), F.least(attempt, F.lit(30)))).cast("long")


def rate_units(chars: Column, unit: int, most: int = 20) -> Column:
    """Calls that a request counts as, one at least; the unit grows so that there are at most `most`."""
    wide = F.greatest(F.lit(unit), F.ceil(chars / most), F.lit(1))
    return F.greatest(F.lit(1), F.ceil(chars / wide)).cast("int")


def version_key(version: Column) -> Column:
    """A struct that sorts as versions do: four numbers, a release after its prereleases, prereleases by their parts, in
    which numbers count as numbers. What is no version is 0."""
    plain = r"^\d{1,9}(?:\.\d{1,9}){0,3}(?:-[0-9A-Za-z.-]{1,31})?(?:\+[0-9A-Za-z.+-]{0,31})?$"
    known = F.when((F.length(version) <= 48) & version.rlike(plain), version).otherwise("0")
    numbers = F.split(F.regexp_extract(known, r"^[0-9.]+", 0), r"\.")
    pre = F.regexp_extract(known, r"^[0-9.]+-([0-9A-Za-z.-]+)", 1)
    parts = F.regexp_extract_all(F.lower(pre), F.lit(r"(\d+|\D+)"), 1)
    padded = F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 31, "0")).otherwise(x))
    return F.struct(*(F.coalesce(F.get(numbers, F.lit(i)).cast("long"), F.lit(0)).alias(f"n{i}") for i in range(4)), (pre == "").alias("release"), F.array_join(padded, "").alias("pre"))


def version_matches(version: Column, expression: str) -> Column:
    """Does the version meet all comparators (<, <=, >, >=, = or none, blanks or commas between)?"""
    out = F.lit(True)
    for token in re.split(r"[\s,]+", expression):
        if not token:
            continue
        found = re.fullmatch(r"(<=|>=|<|>|=)?(\d+(?:\.\d+){0,3}(?:-[0-9A-Za-z.-]+)?)", token)
        if not found:
            raise ValueError(f"no version comparator: {token}")
        a, b = version_key(version), version_key(F.lit(found[2]))
        out = out & {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "=": a == b}[found[1] or "="]
    return out


def version_in_range(version: Column, low: str, high: str) -> Column:
    """low <= version < high."""
    return version_matches(version, f">={low} <{high}")


def two_decimals(value: Column) -> Column:
    """Rounded half up as the exact binary value has it (2.675 is stored a little below, so 2.67). Spark's round goes by
    the shortest decimal form, so this one runs on Arrow batches; use it where parity in the last digit counts."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cent = Decimal("0.01")
        for batch in batches:
            yield batch.map(lambda x: float(Decimal(x).quantize(cent, ROUND_HALF_UP)), na_action="ignore")

    return F.pandas_udf(run, "double")(value)
