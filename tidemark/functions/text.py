"""Text functions on cue texts, as column expressions that stay inside the JVM.

Lengths and offsets count code points. White space is Unicode's.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Music signs, style tags, sentence ends, weights.
MUSIC = "♩♪♫♬"
STYLE_TAG = r"(?i)</?(?:i|b|u|s|font)(?:\s[^>]*)?>"
OVERRIDE = r"\{[^}]*\}"
AN_TAG = r"\{\\an\d\}"
LATIN_WORD_WEIGHT, DIGIT_WEIGHT = 2.5, 0.5
#: Script ranges as Java spells them; the weight in script votes is 3 for all but Latin.
SCRIPTS = ("Han", "Hiragana", "Katakana", "Hangul", "Cyrillic", "Arabic", "Hebrew", "Thai", "Greek", "Devanagari", "Latin")


def normalise_newlines(text: Column) -> Column:
    """CRLF and CR to LF, without a byte order mark."""
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), r"\r\n?", "\n")


def newline_style(text: Column) -> Column:
    """The majority of lf, crlf and cr; lf wins ties, then crlf."""
    crlf = F.regexp_count(text, F.lit(r"\r\n"))
    cr = F.regexp_count(text, F.lit(r"\r")) - crlf
    lf = F.regexp_count(text, F.lit(r"\n")) - crlf
    return F.when((lf >= crlf) & (lf >= cr), "lf").when(crlf >= cr, "crlf").otherwise("cr")


def tidy_lines(text: Column) -> Column:
    """Inline white space collapsed, lines trimmed, empty lines dropped."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.btrim(F.regexp_replace(x, r"(?U)[^\S\n]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def join_lines(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip_markup(text: Column, keep_style: bool = False) -> Column:
    plain = F.regexp_replace(text, OVERRIDE, "")
    return plain if keep_style else F.regexp_replace(plain, r"</?[A-Za-z][^>]*>", "")


def strip_alignment(text: Column) -> Column:
    return F.regexp_replace(text, AN_TAG, "")


def alignment(text: Column) -> Column:
    r"""The corner of the first {\anN}, but for 2, the usual place."""
    found = F.regexp_extract(text, r"\{[^}]*\\an([1-9])", 1).try_cast("int")
    return F.when(found != 2, found)


def collapse_style_wraps(text: Column) -> Column:
    """A style tag that closes and opens again over white space goes."""
    return F.regexp_replace(text, r"(?i)</(i|b|u)>(\s*)<\1>", "$2")


def is_music(text: Column) -> Column:
    return text.rlike(f"[{MUSIC}]")


def translatable(text: Column) -> Column:
    """Is there anything but white space, punctuation, numbers, symbols, format characters and music signs?"""
    return strip_markup(text).rlike(rf"(?U)[^\s\p{{P}}\p{{N}}\p{{S}}\p{{Cf}}{MUSIC}]")


def content_chars(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]")).cast("long")


def plausible_length(source: Column, target: Column, low: float = 0.15, high: float = 6.0) -> Column:
    return F.when(content_chars(source) == 0, True).otherwise((content_chars(target) / content_chars(source)).between(low, high))


def weighted_length(text: Column) -> Column:
    """Latin words 2.5, digits 0.5, other letters and digits 1; a text without any of them by its UTF-16 length."""
    once = lambda value, use: F.transform(F.array(value), use)[0]

    def length(plain: Column) -> Column:
        words = F.regexp_count(plain, F.lit(r"[A-Za-z]+(?:['’][A-Za-z]+)*"))
        digits = F.regexp_count(plain, F.lit("[0-9]"))
        others = F.regexp_count(plain, F.lit(r"[[^\x00-\x7F]&&[\p{L}\p{N}]]"))
        units = F.length(plain) + F.regexp_count(plain, F.lit(r"[\x{10000}-\x{10FFFF}]"))
        return once(LATIN_WORD_WEIGHT * words + DIGIT_WEIGHT * digits + others, lambda w: F.when(w > 0, w).otherwise(units))

    return once(F.regexp_replace(text, STYLE_TAG, ""), length)


def visible_lines(text: Column) -> Column:
    lines = F.split(F.replace(text, F.lit("\\N"), F.lit("\n")), "\n")
    return F.filter(F.transform(lines, lambda x: join_lines(strip_markup(x))), lambda x: x != "")


def reading_speed(text: Column, duration_ms: Column) -> Column:
    """Characters a second, a line break counting as one."""
    lines = visible_lines(text)
    total = F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x)) + F.greatest(F.size(lines) - 1, F.lit(0))
    return total / F.greatest(duration_ms / 1000, F.lit(0.001))


def longest_line(text: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(visible_lines(text), lambda x: F.length(x))), F.lit(0))


def script_counts(text: Column) -> Column:
    """Letters by script, as a map."""
    return F.map_from_arrays(F.array(*map(F.lit, SCRIPTS)), F.array(*(F.regexp_count(text, F.lit(rf"\p{{Is{s}}}")) for s in SCRIPTS)))


def main_script(text: Column) -> Column:
    """The script with most letters, all but Latin weighing three times; kana wins outright."""
    n = {s: F.regexp_count(text, F.lit(rf"\p{{Is{s}}}")) for s in SCRIPTS}
    ranked = F.array_max(F.array(*(F.struct((n[s] * (1 if s == "Latin" else 3)).alias("n"), F.lit(-i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(SCRIPTS))))
    return F.when(n["Hiragana"] + n["Katakana"] > 0, "Kana").when(ranked["n"] > 0, ranked["s"])


def capitalised(text: Column) -> Column:
    """Does the first letter stand in upper case?"""
    return F.regexp_extract(text, r"\p{L}", 0).rlike(r"\p{Lu}")


def html_escape(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def html_unescape(text: Column) -> Column:
    out = text
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def balanced_styles(text: Column) -> Column:
    """The text, without its style tags where one is opened and not closed or the other way round."""
    even = F.lit(True)
    for tag in ("i", "b", "u"):
        even &= F.regexp_count(text, F.lit(rf"(?i)<{tag}>")) == F.regexp_count(text, F.lit(rf"(?i)</{tag}>"))
    return F.when(even, text).otherwise(F.regexp_replace(text, STYLE_TAG, ""))


def stutter_strip(text: Column) -> Column:
    """`I-I am` to `I am`: a repeated beginning before a hyphen goes."""
    return F.regexp_replace(text, r"(?i)\b(\p{L}{1,3})(?:-\1)+(?=\p{L}*\b)", "$1")


def ellipses(text: Column) -> Column:
    """Dots and spaced dots to one ellipsis, without white space before it."""
    return F.regexp_replace(F.regexp_replace(text, r"\.{3,}|(?:\. ){2,}\.", "…"), r"\s+…", "…")


def dash_segments(text: Column) -> Column:
    """Dialogue turns: lines that a dash begins, with the lines that follow them."""
    marked = F.regexp_replace(F.btrim(text), r"(?m)^\s*[-–—‐]\s*(?=\S)", "\u0001")
    turns = F.transform(F.split(marked, "\u0001"), lambda x: F.btrim(x, F.lit(" \n\t")))
    return F.filter(turns, lambda x: x != "")


def dash_style(dashed: Column) -> Column:
    """`- ` if at least two thirds of the first nine dashed lines (an array) have a space, else `-`."""
    first = F.slice(dashed, 1, 9)
    spaced = F.size(F.filter(first, lambda x: x.rlike(r"^\s*[-–—]\s")))
    return F.when((F.size(first) > 0) & (3 * spaced >= 2 * F.size(first)), "- ").otherwise("-")


def music_line(text: Column) -> Column:
    """A line of music signs and words as `♪ words ♪`."""
    core = F.btrim(F.regexp_replace(text, f"^[{MUSIC}#\\s]+|[{MUSIC}#\\s]+$", ""))
    return F.when(is_music(text) & (core != ""), F.concat(F.lit("♪ "), core, F.lit(" ♪"))).otherwise(text)


def strip_captions(text: Column, rounds: int = 3) -> Column:
    """Bracketed sound captions removed, also nested ones, and the lines tidied; music signs stay."""
    out = text
    for _ in range(rounds):
        out = F.regexp_replace(out, rf"[\[(（【][^\[\](){{}}（）【】{MUSIC}]*[\])）】]", "")
    return tidy_lines(out)


def strip_speaker(text: Column) -> Column:
    """Upper-case `NAME:` at the beginning of lines removed."""
    return F.regexp_replace(text, r"(?m)^(\s*[-–—]?\s*)\p{Lu}[\p{Lu}\d .'’&-]{1,29}:\s+", "$1")


def speaker_label(text: Column) -> Column:
    """The label before a colon: at most three words, shouted."""
    return F.nullif(F.regexp_extract(text, r"^\s*[-–—]?\s*(\p{Lu}[\p{Lu}\d.'’-]*(?: \p{Lu}[\p{Lu}\d.'’-]*){0,2}):", 1), F.lit(""))


def bracket_removal_without_source(text: Column, source: Column) -> Column:
    brackets = r"[\[(（【][^\[\]()（）【】]*[\])）】]"
    return F.when(source.rlike(r"[\[\](){}（）【】]"), text).otherwise(join_lines(F.regexp_replace(F.regexp_replace(text, brackets, ""), brackets, "")))


def equal_but_noise(a: Column, b: Column) -> Column:
    """Equal apart from punctuation, numbers, symbols and white space, with at least two words."""
    noise = rf"(?U)[\s\p{{P}}\p{{N}}\p{{S}}\p{{Cf}}{MUSIC}]"
    words = F.regexp_count(a, F.lit(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]|[\p{L}\p{N}_]+"))
    return (F.regexp_replace(a, noise, "") == F.regexp_replace(b, noise, "")) & (words >= 2)


def compact_number(n: Column) -> Column:
    """Whole below a thousand, then k and M: one decimal below ten of them, none from ten on. Ties go up, but where the
    quotient as a double lies below the tie, as it does for 1150, they go down."""

    def cut(size: int, unit: str) -> Column:
        below = [x for x in range(size + size // 20, 10 * size, size // 10) if Decimal(x / size) * size < x]
        tenths = F.floor((n + size // 20) / (size // 10)) - F.when(n.isin(below), 1).otherwise(0)
        fine = F.concat(F.floor(tenths / 10).cast("string"), F.when(tenths % 10 == 0, "").otherwise(F.concat(F.lit("."), (tenths % 10).cast("string"))))
        return F.concat(F.when(n < 10 * size, fine).otherwise(F.floor((n + size // 2) / size).cast("string")), F.lit(unit))

    whole = F.floor(F.greatest(n, F.lit(0))).cast("string")
    return F.when(n.isNull() | F.isnan(n.cast("double")), "0").when(n < 1000, whole).when(n < 1_000_000, cut(1000, "k")).otherwise(cut(1_000_000, "M"))


def base_language(tag: Column) -> Column:
    return F.lower(F.regexp_extract(tag, r"^([A-Za-z]{2,3})", 1))


def right_to_left(tag: Column) -> Column:
    return base_language(tag).isin("ar", "fa", "he", "ur", "yi", "ps", "sd", "ug", "dv")


def fold_accents(text: Column) -> Column:
    """Lower case without the combining marks of Latin letters (precomposed letters by their groups)."""
    out = F.lower(text)
    for plain, accented in (("a", "àáâãäåāăą"), ("c", "çćč"), ("d", "ďđ"), ("e", "èéêëēęě"), ("i", "ìíîïī"), ("l", "ł"), ("n", "ñńň"), ("o", "òóôõöøōő"), ("r", "ŕř"), ("s", "śšş"), ("t", "ť"), ("u", "ùúûüūůű"), ("y", "ýÿ"), ("z", "źżž")):
        out = F.translate(out, accented, plain * len(accented))
    return out


def file_format(path: Column) -> Column:
    """srt, vtt or ass by the extension; srt where it is none of them."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext.isin("ass", "ssa"), "ass").when(ext == "vtt", "vtt").otherwise("srt")


def file_kind(path: Column) -> Column:
    """subtitle, zip, matroska, archive, media or other. Fixed lists of extensions."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return (
        F.when(ext.isin("srt", "vtt", "ass", "ssa"), "subtitle")
        .when(ext == "zip", "zip")
        .when(ext.isin("mkv", "mks", "webm"), "matroska")
        .when(ext.isin("rar", "7z", "tar", "gz", "tgz", "bz2", "xz", "iso"), "archive")
        .when(ext.isin("mp4", "m4v", "mov", "avi", "wmv", "flv", "ts", "mpg", "mpeg", "mp3", "m4a", "aac", "flac", "wav", "ogg", "jpg", "jpeg", "png", "gif", "pdf"), "media")
        .otherwise("other")
    )


def output_name(name: Column, fmt: Column, source: Column, target: Column, bilingual: bool = False) -> Column:
    base = F.regexp_replace(F.coalesce(F.nullif(name, F.lit("")), F.lit("subtitle")), r"(?i)\.(srt|vtt|ass|ssa|lrc)$", "")
    src = F.when(source.isNull() | source.isin("", "auto"), "en").otherwise(source)
    middle = [F.coalesce(F.nullif(target, F.lit("")), F.lit("zh"))] + ([src] if bilingual else [])
    return F.concat_ws(".", base, *middle, fmt)
