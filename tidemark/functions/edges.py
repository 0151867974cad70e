"""Edges of cues: how a text ends and begins, whether a sentence goes on from one text to the next, and what of a quote
or bracket is left open. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import text as T

# Classes of characters.
BLANK = "\t\n\v\f\r \u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))
TERMINAL = ".!?…⋯。！？‼⁇⁈⁉؟۔।॥" + "\u0589\u037e\u104b\u1362"
GOES_ON = ",;:、，；："
NOTES = "♪♫♩♬*†‡※★☆"
STRAIGHT = "\"'"
BRACKETS_OPEN = "([{（［｛〔〖〘〚〈《【⟨⟪"
BRACKETS_CLOSE = ")]}）］｝〕〗〙〛〉》】⟩⟫"
CLOSERS = BRACKETS_CLOSE + "＞”’»›」』〞〟"
BOUND = "、。，．；：・ゝゞヽヾ々〻」』〞〟"
OPENERS = "（［｛〔〖〘〚〈《【⟨⟪「『〝¿¡¥￥＄£＃№§＠"
QUOTES_OPEN = "“「«"
QUOTES_CLOSE = "”」»"
NO_LINE_END = "“「『（([{＜〈《【〔„‚«‹¿¡'\"‘"
NO_LINE_START = "”」』）)]}＞〉》】〕»›、，,。.！!？?；;：:·'\"’"
DOMAINS = "com|net|org|io|co|tv|me|app|dev|ai|edu|gov|info|biz|xyz|uk|cn|jp|de|fr|ru|us|ca|au|fm|ly|gg"

# Flags and times in milliseconds.
TAIL_TERMINAL, TAIL_ELLIPSIS, TAIL_CONTINUATION, TAIL_DASH, TAIL_CLOSED, TAIL_OPENER = 1, 2, 4, 8, 16, 32
HEAD_ELLIPSIS, HEAD_LOWER, HEAD_UPPER, HEAD_CLOSER = 1, 2, 4, 8
CLOSE_MS, ADJACENT_MS, OVERLAP_MS = 200, 1500, 1000
SHORT_REPLY, CAPTION_WORDS = 3, 3

STYLE = "</?[ibuIBU]>"
WORD = r"\p{IsLatin}+(?:['’]\p{IsLatin}+)*"
TURN = rf"(?i)(?:^|(?<=\s))(?:{STYLE})*-(?!-)(?:{STYLE})*\s?"


def char_class(chars: str) -> str:
    return "[" + "".join("\\" + c if c in "[]{}()^-&\\" else c for c in chars) + "]"


def has(flags: Column, flag: int) -> Column:
    return flags.bitwiseAND(flag) != 0


def _sum(*flags: tuple[Column, int]) -> Column:
    out = F.lit(0)
    for test, flag in flags:
        out = out + F.when(test, flag).otherwise(0)
    return out


def tail_flags(text: Column) -> Column:
    """Flags of the last character before blanks, notes, closing quotes and closing style tags. Null gives 0."""
    text = F.coalesce(text, F.lit(""))
    ending = F.regexp_extract(text, rf"(?:{char_class(BLANK + NOTES + CLOSERS + STRAIGHT)}|</[ibuIBU]>)++$", 0)
    content = F.left(text, F.length(text) - F.length(ending))
    last, two = F.right(content, F.lit(1)), F.right(content, F.lit(2))
    ellipsis = last.isin("…", "⋯") | (two == "..")
    terminal = ~ellipsis & (last.rlike(char_class(TERMINAL)) | (two == "--"))
    return _sum(
        (terminal, TAIL_TERMINAL), (ellipsis, TAIL_ELLIPSIS), (last.rlike(char_class(GOES_ON)), TAIL_CONTINUATION), ((last == "-") & (two != "--"), TAIL_DASH),
        (ending.rlike(char_class(CLOSERS + STRAIGHT)), TAIL_CLOSED), (last.rlike(char_class(OPENERS)), TAIL_OPENER),
    )


def head_flags(text: Column) -> Column:
    """Flags of the first character after blanks, notes, style tags and straight quotes, and the case of the first letter.
    Null gives 0."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^(?:{char_class(BLANK + NOTES)}|{STYLE})++", "")
    lead = F.regexp_replace(body, "^[\"']+", "")
    ellipsis = lead.rlike(r"^(?:…|\.\.)")
    letter = F.regexp_extract(F.regexp_replace(body, STYLE, ""), r"\p{L}", 0)
    return _sum(
        (ellipsis, HEAD_ELLIPSIS), (letter.rlike(r"\p{Ll}"), HEAD_LOWER), (letter.rlike(r"[\p{Lu}\p{Lt}]"), HEAD_UPPER), (lead.rlike("^" + char_class(BRACKETS_CLOSE + BOUND)), HEAD_CLOSER),
    )


def splits_domain(before: Column, text: Column, head: Column) -> Column:
    """Does a full stop at the end of the one and a top level domain at the beginning of the other make a host name?"""
    return has(head, HEAD_LOWER) & before.rlike(r"[\p{L}\p{N}-]\.\s*$") & text.rlike(rf"^\s*(?:{DOMAINS})(?:[^\p{{L}}\p{{N}}]|$)")


def goes_on(before: Column, tail: Column, text: Column, head: Column, gap: Column) -> Column:
    """Does a sentence go on from the text before, by punctuation, case and the gap between them in milliseconds?"""
    lower, near, adjacent = has(head, HEAD_LOWER), gap <= CLOSE_MS, gap <= ADJACENT_MS
    return (
        F.when(has(tail, TAIL_TERMINAL), near & splits_domain(before, text, head))
        .when(has(tail, TAIL_DASH), near & lower)
        .when(has(tail, TAIL_ELLIPSIS) & has(head, HEAD_ELLIPSIS), adjacent)
        .when(has(tail, TAIL_ELLIPSIS) & has(head, HEAD_UPPER), False)
        .when(has(tail, TAIL_CONTINUATION) & adjacent, True)
        .otherwise(near | lower)
    )


def bare_caption(text: Column, tail: Column) -> Column:
    """One to three words in capitals without punctuation at the end: a caption, not a sentence."""
    words = F.regexp_count(text, F.lit(WORD))
    return (tail.bitwiseAND(63 - TAIL_CLOSED) == 0) & words.between(1, CAPTION_WORDS) & (text == F.upper(text)) & (text != F.lower(text))


def goes_on_latin(before: Column, tail: Column, text: Column, head: Column, gap: Column) -> Column:
    return ~(bare_caption(before, tail) & ~has(head, HEAD_LOWER)) & goes_on(before, tail, text, head, gap)


def short_reply(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\p{IsLatin}\p{N}]")) <= SHORT_REPLY


def isolated_short(text: Column, most_words: int) -> Column:
    return F.regexp_count(text, F.lit(WORD)) <= most_words if most_words else F.lit(False)


def music_goes_on(text: Column) -> Column:
    head = head_flags(F.regexp_replace(text, char_class(T.MUSIC), ""))
    return has(head, HEAD_LOWER) & ~has(head, HEAD_ELLIPSIS)


def open_after(text: Column, pending: bool) -> Column:
    """Is a quote or bracket open after the text, if one was (pending) or was not before it? The last paired sign
    decides, each straight quote after it turns the state; one that begins the text doesn't close what is pending."""
    text = F.coalesce(text, F.lit(""))
    opening, paired = char_class(QUOTES_OPEN + BRACKETS_OPEN), char_class(QUOTES_OPEN + BRACKETS_OPEN + QUOTES_CLOSE + BRACKETS_CLOSE)
    sign, rest = F.regexp_extract(text, f"(?s)^.*({paired})", 1), F.regexp_extract(text, f"(?s)^(?:.*{paired})?(.*)$", 1)
    turns = F.regexp_count(rest, F.lit('"')) % 2 == 1
    if not pending:
        return turns != ((sign != "") & sign.rlike(opening))
    return F.when(sign != "", turns != sign.rlike(opening)).otherwise(turns == text.startswith('"'))


def turns(text: Column) -> Column:
    """Dialogue turns, each opened by a dash after white space; the whole text where there is none."""
    found = F.filter(F.transform(F.split(F.regexp_replace(text, TURN, "\u0001"), "\u0001"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.when(text.rlike(TURN) & (F.size(found) > 0), found).otherwise(F.array(text))


def place_punctuation(parts: Column) -> Column:
    """Signs that may not end a part go to the next one, then signs that may not begin a part to the one before."""
    cut = "\u0001"

    def step(done: Column, part: Column) -> Column:
        both = F.concat(F.element_at(done, -1), F.lit(cut), part)
        moved = F.regexp_replace(both, f"({char_class(NO_LINE_END)}+){cut}", f"{cut}$1")
        moved = F.split(F.regexp_replace(moved, f"{cut}({char_class(NO_LINE_START)}+)", f"$1{cut}"), cut)
        moved = F.concat(F.slice(done, 1, F.size(done) - 1), moved)
        moves = F.right(F.element_at(done, -1), F.lit(1)).rlike(char_class(NO_LINE_END)) | F.left(part, F.lit(1)).rlike(char_class(NO_LINE_START))
        return F.when(~moves, F.concat(done, F.array(part))).otherwise(moved)

    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    moved = F.when(F.size(parts) > 0, F.aggregate(rest, F.slice(parts, 1, 1), step)).otherwise(parts)
    return F.transform(moved, lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
