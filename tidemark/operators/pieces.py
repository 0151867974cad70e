"""Texts in pieces of a vocabulary: WordPiece, unigram pieces, and words of scripts that have no blanks.

A vocabulary is a table (piece, id, score), read from its file or made from a corpus. It goes to the tasks whole, so its
size is checked first (MOST_PIECES). Texts stay where they are: there is no shuffle, and what a task has cut before it
remembers, up to MOST_KEPT stretches between blanks; equal ones are cut once, and arrays gathered from them. Places are counted in UTF-16 units, as clients count them.
"""

from __future__ import annotations

import math
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.edges import BLANK

MOST_PIECES = 1 << 20
MOST_KEPT = 1 << 18
GROUP_CHARS = 1 << 20
BATCH_BYTES = 4 << 20

# Limits, special pieces, classes of characters.
LONGEST_WORD, LONGEST_PIECE = 100, 24
INNER, BOUNDARY = "##", "\u2581"
WORDPIECE_SPECIAL = ["[UNK]", "[CLS]", "[SEP]"]
UNIGRAM_SPECIAL = ["<s>", "</s>", "<pad>"]
UNKNOWN_PENALTY = 10.0
SPACE = r"\t\n\v\f\r\p{Zs}\p{Zl}\p{Zp}\ufeff"
DROPPED = r"\p{Cc}\p{Cf}\ufffd"
HAN = r"\u4e00-\u9fff\u3400-\u4dbf\U00020000-\U0002a6df\U0002a700-\U0002b73f\U0002b740-\U0002b81f\U0002b820-\U0002ceaf\uf900-\ufaff\U0002f800-\U0002fa1f"
ALONE = rf"{HAN}!-/:-@\[-`{{-~\p{{P}}"
UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\u30fc\u3005\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
JOINERS = "'\u2019.\u00b7"
BLANK_RUN = r" \u1680\u2000-\u2006\u2008-\u200a\u205f\u3000"

WORDS = "array<struct<start int, end int, pieces array<int>>>"
TOKENS = "array<struct<text string, is_word boolean>>"

_WORD = regex.compile(rf"[{ALONE}]|[^{ALONE}{SPACE}{DROPPED}]+")
_SPACE, _DROPPED = regex.compile(f"[{SPACE}]"), regex.compile(f"[{DROPPED}]")
_CHANGED = regex.compile(f"[{SPACE}{DROPPED}]")
_CHUNK, _STRETCH = re.compile(f"[^{BLANK}]+"), re.compile(f"[^{BLANK}]+|[{BLANK}]+")

#: Starts and ends of words in UTF-16 units, their numbers of pieces, and the ids of all pieces.
Cut = tuple[Sequence[int], Sequence[int], Sequence[int], Sequence[int]]


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their ids and scores, as tasks hold them; unknown is the id of what is in no piece."""

    ids: Mapping[str, int]
    scores: Mapping[str, float] = field(default_factory=dict)
    unknown: int = 0


def wordpiece_file(spark: SparkSession, path: str) -> DataFrame:
    """The table of a file with a piece a line; the number of the line is its id."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("id", "piece"))
    return lines.select(F.regexp_replace("piece", "\r$", "").alias("piece"), "id", F.lit(0.0).alias("score")).where("piece <> ''")


def unigram_file(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The table of a JSON definition ({model: {type, unk_id, vocab: [[piece, score]]}}) and the id of unknown text."""
    model = spark.read.text(path, wholetext=True).select(F.from_json("value", "model struct<type string, unk_id int, vocab array<array<string>>>")["model"].alias("m"))
    head = model.select("m.type", "m.unk_id").first()
    if head["type"] != "Unigram" or head["unk_id"] is None:
        raise ValueError("not a unigram definition")
    rows = model.select(F.posexplode("m.vocab").alias("id", "entry"))
    return rows.select(F.col("entry")[0].alias("piece"), "id", F.col("entry")[1].cast("double").alias("score")), head["unk_id"]


def held(table: DataFrame, special: list[str] = [], unknown: int | str = 0) -> Vocabulary:  # noqa: B006
    """A vocabulary from its table (piece, id, score). A piece that comes twice has its greatest id; null pieces are none.
    Raises if it has more than MOST_PIECES pieces or a special one is missing. unknown is an id or a piece."""
    rows = table.where("piece is not null").groupBy("piece").agg(F.max_by(F.struct("id", "score"), "id").alias("x")).select("piece", "x.id", "x.score")
    size = rows.count()
    if size > MOST_PIECES:
        raise ValueError(f"{size} pieces; a vocabulary has at most {MOST_PIECES}")
    found = rows.toPandas()
    ids = dict(zip(found["piece"], found["id"].astype(int).tolist(), strict=True))
    missing = [piece for piece in [*special, *([unknown] if isinstance(unknown, str) else [])] if piece not in ids]
    if missing:
        raise ValueError(f"pieces missing: {missing}")
    return Vocabulary(ids, dict(zip(found["piece"], found["score"].astype(float).tolist(), strict=True)), ids[unknown] if isinstance(unknown, str) else unknown)


def best_path(text: str, scores: Mapping[str, float], longest: int, unknown: float) -> list[tuple[int, int]]:
    """Ends of the pieces with the greatest sum of scores. A character that is no piece scores `unknown`; of equal paths
    to a place the one with the longer last piece is taken."""
    totals, starts, get = [0.0], [0], scores.get
    for end in range(1, len(text) + 1):
        at = end - 1
        total = totals[at] + get(text[at:end], unknown)
        for other in range(at - 1, max(end - longest, 0) - 1, -1):
            score = get(text[other:end])
            if score is not None and totals[other] + score >= total:
                at, total = other, totals[other] + score
        totals.append(total)
        starts.append(at)
    path, end = [], len(text)
    while end:
        path.append((starts[end], end))
        end = starts[end]
    return path[::-1]


def remembered(f: Callable) -> Callable:
    kept: dict = {}

    def look(key):
        if key not in kept:
            if len(kept) >= MOST_KEPT:
                kept.clear()
            kept[key] = f(key)
        return kept[key]

    return look


class Pool(dict):
    """Stretches by number, each cut once, with flat arrays of their words and pieces."""

    def __init__(self, cut: Callable[[str], Cut]):
        self.cut = cut
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.units, self.words, self.starts, self.ends, self.sizes, self.ids = (array("i") for _ in range(6))

    def __missing__(self, part: str) -> int:
        starts, ends, sizes, ids = self.cut(part)
        wide = None if part.isascii() or max(part) <= "\uffff" else offsets([1 + (char > "\uffff") for char in part]).tolist()
        self.units.append(wide[-1] if wide else len(part))
        self.words.append(len(starts))
        self.starts.extend([wide[i] for i in starts] if wide else starts)
        self.ends.extend([wide[i] for i in ends] if wide else ends)
        self.sizes.extend(sizes)
        self.ids.extend(ids)
        self[part] = len(self)
        return self[part]


def gather(sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Places of the items of lists (codes) in a flat array of lists that have these sizes."""
    taken, first = sizes[codes], np.cumsum(sizes) - sizes
    return np.repeat(first[codes] - np.cumsum(taken) + taken, taken) + np.arange(taken.sum())


def word_arrays(cut: Callable[[str], Cut], whole: bool = False, unknown: int | None = None) -> Callable[[pa.Array], pa.Array]:
    """Batches of texts to arrays of WORDS. Texts are cut between blanks, or not at all (whole). With an id of unknown
    pieces (one a word), those side by side become one, and a boundary that stands for no character of a text goes."""
    pool = Pool(cut)
    stretches = (lambda text: [text] if text else []) if whole else _STRETCH.findall

    def group(texts: list[str]) -> tuple[np.ndarray, ...]:
        if whole or len(pool) > MOST_KEPT:
            pool.empty()
        found = [stretches(text) for text in texts]
        codes = np.fromiter((pool[part] for parts in found for part in parts), np.int64)
        units, words, starts, ends, sizes, ids = (np.array(x, np.int64) for x in (pool.units, pool.words, pool.starts, pool.ends, pool.sizes, pool.ids))
        counts = [len(parts) for parts in found]
        reach = np.r_[0, np.cumsum(units[codes])]
        moved = np.repeat(reach[:-1] - np.repeat(reach[offsets(counts)[:-1]], counts), words[codes])
        owner = np.repeat(np.repeat(np.arange(len(texts)), counts), words[codes])
        at = gather(words, codes)
        starts, ends, ids, sizes = starts[at] + moved, ends[at] + moved, ids[gather(sizes, at)], sizes[at]
        if unknown is not None and len(at):
            odd, fresh = ids == unknown, np.r_[True, owner[1:] != owner[:-1]]
            first = np.flatnonzero(fresh | ~(odd & np.r_[False, odd[:-1]]))
            last = np.r_[first[1:], len(ids)] - 1
            starts, ends, ids, sizes, owner, fresh = starts[first], ends[last], ids[first], sizes[first], owner[first], fresh[first]
            kept = ~(fresh & (starts == ends))
            starts, ends, ids, sizes, owner = starts[kept], ends[kept], ids[kept], sizes[kept], owner[kept]
        return starts, ends, sizes, ids, np.bincount(owner, minlength=len(texts))

    def batch(texts: pa.Array) -> pa.Array:
        plain = ["" if text is None else text for text in texts.to_pylist()]
        numbers = np.cumsum([len(text) for text in plain]) // GROUP_CHARS
        bounds = [0, *(np.flatnonzero(np.diff(numbers)) + 1), len(plain)] if plain else [0]
        parts = [group(plain[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
        starts, ends, sizes, ids, counts = (np.concatenate([np.empty(0, np.int64), *(x[k] for x in parts)]).astype(np.int32) for k in range(5))
        pieces = pa.ListArray.from_arrays(offsets(sizes), pa.array(ids, pa.int32()))
        words = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pieces], ["start", "end", "pieces"])
        return listed(texts, words, counts)

    return batch


def cut_word(word: str, ids: Mapping[str, int], unknown: int, longest: int) -> list[int]:
    """The longest piece from the left, again and again; a word that is not used up, or has over 100 characters, is
    unknown as a whole."""
    pieces: list[int] = []
    mark, at, size = "", 0, len(word)
    while at < size <= LONGEST_WORD:
        end = min(size, at + longest)
        while end > at and mark + word[at:end] not in ids:
            end -= 1
        if end == at:
            return [unknown]
        pieces.append(ids[mark + word[at:end]])
        mark, at = INNER, end
    return pieces or [unknown]


def wordpiece_arrays(vocabulary: Vocabulary) -> Callable[[pa.Array], pa.Array]:
    longest = max((len(p) for p in vocabulary.ids), default=0)
    pieces = remembered(lambda word: cut_word(word, vocabulary.ids, vocabulary.unknown, longest))

    def cut(text: str) -> Cut:
        found = [(m.start(), m.end(), pieces(m.group())) for m in _WORD.finditer(text)]
        return [x[0] for x in found], [x[1] for x in found], [len(x[2]) for x in found], [i for x in found for i in x[2]]

    return word_arrays(cut)


@lru_cache(1 << 12)
def folded_char(char: str) -> str | None:
    """NFKC of a character; empty for blanks, None for one that is dropped."""
    plain = unicodedata.normalize("NFKC", char)
    return "" if _SPACE.fullmatch(plain) else None if _DROPPED.fullmatch(char) else plain


def folded(text: str) -> tuple[str, list[int], list[int]]:
    """NFKC of each character by itself, a boundary for blanks between others, and where each character comes from. A
    boundary stands before all."""
    size = len(text)
    if size and unicodedata.is_normalized("NFKC", text) and not _CHANGED.search(text):
        return BOUNDARY + text, [0, *range(size)], [0, *range(1, size + 1)]
    out, starts, ends, blank = [BOUNDARY], [0], [0], False
    for n, char in enumerate(text):
        plain = folded_char(char)
        if plain == "":
            blank = True
        elif plain is not None:
            if len(out) == 1:
                starts[0] = ends[0] = n
            elif blank:
                out.append(BOUNDARY)
                starts.append(n)
                ends.append(n)
            blank = False
            out.extend(plain)
            starts.extend([n] * len(plain))
            ends.extend([n + 1] * len(plain))
    return "".join(out), starts, ends


def unigram_arrays(vocabulary: Vocabulary) -> Callable[[pa.Array], pa.Array]:
    """Pieces of the best path. Where no piece goes beyond a boundary, stretches between blanks are cut one by one, which
    gives the same path; sums of scores may differ in the last bit."""
    scores, ids, unknown = vocabulary.scores, vocabulary.ids, vocabulary.unknown
    worst = min([0.0, *scores.values()]) - UNKNOWN_PENALTY
    longest = min(LONGEST_PIECE, max((len(p) for p in ids), default=1))

    def cut(text: str) -> Cut:
        plain, starts, ends = folded(text)
        path = best_path(plain, scores, longest, worst) if len(plain) > 1 else []
        return [starts[a] for a, _ in path], [ends[b - 1] for _, b in path], [1] * len(path), [ids.get(plain[a:b], unknown) for a, b in path]

    return word_arrays(cut, any(BOUNDARY in piece[1:] for piece in ids), unknown)


def offsets(sizes: Sequence[int]) -> np.ndarray:
    return np.r_[0, np.cumsum(sizes, dtype=np.int64)].astype(np.int32)


def listed(texts: pa.Array, items: pa.Array, sizes: Sequence[int]) -> pa.Array:
    """Lists of the items, by their sizes; null for null texts."""
    return pa.ListArray.from_arrays(pa.array(offsets(sizes)), items, mask=texts.is_null())


def token_arrays(scores: Mapping[str, float], unknown: float, unspaced: str) -> Callable[[pa.Array], pa.Array]:
    """Batches of texts to arrays of TOKENS."""
    word = rf"[\p{{L}}\p{{N}}\p{{M}}_--{unspaced}]+"
    pattern = regex.compile(rf"(?P<run>[{unspaced}]+)|{word}(?:[{JOINERS}](?=[\p{{L}}\p{{N}}]){word})*|\r\n|[{BLANK_RUN}]+|.", regex.V1 | regex.DOTALL)
    worded = regex.compile(r"[\p{L}\p{N}]")
    longest = max((len(w) for w in scores), default=1)

    @remembered
    def chunk(text: str) -> tuple[list[str], list[bool]]:
        parts: list[str] = []
        for m in pattern.finditer(text):
            run = m.group()
            parts += [run[a:b] for a, b in best_path(run, scores, longest, unknown)] if m.group("run") else [run]
        return parts, [worded.search(part) is not None for part in parts]

    def batch(texts: pa.Array) -> pa.Array:
        parts: list[str] = []
        flags: list[bool] = []
        sizes = []
        for text in texts.to_pylist():
            before = len(parts)
            for found, tests in map(chunk, _STRETCH.findall(text or "")):
                parts += found
                flags += tests
            sizes.append(len(parts) - before)
        return listed(texts, pa.StructArray.from_arrays([pa.array(parts, pa.string()), pa.array(flags, pa.bool_())], ["text", "is_word"]), sizes)

    return batch


def _column(spark: SparkSession, make: Callable[..., Callable[[pa.Array], pa.Array]], args: tuple, kind: str) -> Callable[[Column], Column]:
    shared = spark.sparkContext.broadcast(args)
    # For the session: batches are bounded by bytes, as a batch of long texts has far more pieces than rows.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    @F.arrow_udf(kind)
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from map(make(*shared.value), batches)

    return cut


def word_pieces(spark: SparkSession, table: DataFrame) -> Callable[[Column], Column]:
    """A function of a text column: array<struct<start, end, pieces>> of its words. Words end at blanks and control
    characters; punctuation, ASCII symbols and Han characters stand alone. Null gives null, an empty text no words."""
    return _column(spark, wordpiece_arrays, (held(table, WORDPIECE_SPECIAL, "[UNK]"),), WORDS)


def unigram_pieces(spark: SparkSession, table: DataFrame, unknown: int) -> Callable[[Column], Column]:
    """A function of a text column: array<struct<start, end, pieces>>, a piece each, on the path of the best sum over the
    text in NFKC with boundaries for blanks. Neighbouring unknown pieces are one. Null gives null."""
    return _column(spark, unigram_arrays, (held(table, UNIGRAM_SPECIAL, unknown),), WORDS)


def lexicon(words: DataFrame) -> dict[str, float]:
    """Scores of a table of words (word, count): logarithms of their shares. Words of no length or count are left out."""
    rows = words.where("word <> '' and count > 0").groupBy("word").agg(F.sum("count").alias("count"))
    size, total = rows.agg(F.count("*"), F.sum("count")).first()
    if size > MOST_PIECES:
        raise ValueError(f"{size} words; a lexicon has at most {MOST_PIECES}")
    return {r["word"]: math.log(r["count"] / total) for r in rows.toLocalIterator()}


def word_tokens(spark: SparkSession, scores: Mapping[str, float], unspaced: str = UNSPACED) -> Callable[[Column], Column]:
    """A function of a text column: array<struct<text, is_word>> of its tokens, which put together are the text.

    Runs of scripts without blanks (unspaced, a class) are cut by the best path over the lexicon, where a character in no
    word scores ten less than the rarest word. Other words, runs of blanks and signs are tokens by themselves. Null gives null.
    """
    return _column(spark, token_arrays, (dict(scores), min([0.0, *scores.values()]) - UNKNOWN_PENALTY, unspaced), TOKENS)
