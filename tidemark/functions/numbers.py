"""Small numeric and array rules, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(value: Column) -> Column:
    """To the nearest whole number, ties to the even one."""
    low = F.floor(value)
    rest = value - low
    return (low + F.when(rest > 0.5, 1).when(rest < 0.5, 0).otherwise(F.pmod(low, F.lit(2)))).cast("long")


def lower_bound(values: Column, target: Column) -> Column:
    """How many of the ascending values are less than target: where it would be inserted, before equal ones."""
    return F.size(F.filter(values, lambda x: x < target))


def first_after(values: Column, target: Column) -> Column:
    """How many of the ascending values are not greater than target."""
    return F.size(F.filter(values, lambda x: x <= target))


def nearest(values: Column, target: Column) -> Column:
    """The value with the least distance to target; of equally near ones the first."""
    best = F.array_min(F.transform(values, lambda x, i: F.struct(F.abs(x - target).alias("d"), i.alias("i"), x.alias("x"))))
    return best["x"]


def softmax_max(logits: Column) -> Column:
    """label: the place of the greatest value, of equal ones the first; probability: its share of the softmax."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.struct((F.array_position(logits, top) - 1).cast("int").alias("label"), (1 / total).alias("probability"))


def marker_key(marker: Column) -> Column:
    """A struct by which marker ids such as 12.3 sort as pairs of numbers; a missing second part is 0."""
    parts = F.split(marker, r"\.")
    return F.struct(F.get(parts, F.lit(0)).try_cast("int").alias("cue"), F.coalesce(F.get(parts, F.lit(1)).try_cast("int"), F.lit(0)).alias("sub"))


def truncate_words(text: Column, most: int) -> Column:
    """At most so many characters; a cut inside an ASCII word goes back to the space before it, if there is one."""
    cut = F.substring(text, 1, most)
    inside = F.substring(text, most, 1).rlike("[A-Za-z]") & F.substring(text, most + 1, 1).rlike("[A-Za-z]")
    back = F.regexp_replace(cut, r"(?s)^(.+) [^ ]*$", "$1")
    trimmed = lambda x: F.regexp_replace(x, r"(?U)\s+$", "")
    return F.when(F.length(text) <= most, text).when(inside, trimmed(back)).otherwise(trimmed(cut))


def free_start(earliest: Column, spans: Column, duration_ms: int, gap_ms: int) -> Column:
    """The start of a cue of that duration, not before earliest, that meets none of the spans (start, end), tried in
    order of their starts."""
    step = lambda at, s: F.when((s["start"] < at + duration_ms) & (s["end"] > at), s["end"] + gap_ms).otherwise(at)
    return F.aggregate(F.array_sort(spans), earliest.cast("long"), step)


def contains_all(whole: Column, part: Column) -> Column:
    """Is part not empty and all of it in whole?"""
    return (F.size(part) > 0) & (F.size(F.array_except(part, whole)) == 0)


def attach_dangling(text: Column) -> Column:
    """Lines at the ends that are nothing but tags are moved to the line beside them."""
    tags = r"((?:<[^>\n]*>|\{[^}\n]*\})+)"
    return F.regexp_replace(F.regexp_replace(text, rf"^{tags}\n", "$1"), rf"\n{tags}$", "$1")


def join_open_brackets(lines: Column) -> Column:
    """Lines with a bracket that stays open take in the lines that follow, until it closes."""
    opened = lambda x: F.regexp_count(x, F.lit(r"[(\[（【]")) > F.regexp_count(x, F.lit(r"[)\]）】]"))
    # A line of a cue is a short text, and a cue has few.
    step = lambda a, x: F.when((F.size(a) > 0) & opened(F.element_at(a, -1)), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.concat(F.element_at(a, -1), F.lit(" "), x)))).otherwise(F.concat(a, F.array(x)))
    return F.aggregate(lines, F.array().cast("array<string>"), step)
