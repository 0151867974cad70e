"""Packing of tokenised documents into sequences by bulk-synchronous best fit.

Documents are cut only where they are longer than a sequence. Pieces longer than half a sequence open one each; others
open as many more as the tokens need at least. Then rounds follow. In each, pieces and gaps are put in order of size
(a gap that holds the longest piece that is left several times is several slots), and a sweep over that order, from
short to long, lets every slot take the longest piece before it that no shorter slot has taken. The sweep is that of
matching brackets: a piece opens, a slot closes, and both meet at the same depth. A row's depth is its rank among the
pieces and slots of all sizes, so it needs no row but itself and the counts by size; of rows of one size, which would all
want the same slot, the rank decides. Rows of one depth, at most two for each size, meet in a window. Then gaps are
updated, pieces longer than every gap open sequences, and the next round begins, until no piece is left.

Ranks are counted in two steps, by size and a salt; sizes with many rows have more salts, so that no group of rows of
one size is a task of its own. The driver gets the numbers of pieces and gaps by size, at most 4096 each. Each round is
stored in the shared folder.

Defined results: null text is empty and gives the end token alone; each row is packed, also repeated ones; a null doc_id
is carried along; very long texts are cut into pieces in one task; an empty table gives an empty one; further columns
are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .packing import SPACE
from .session import release, small_batches, stash
from .textwords import slices

#: Tokens never cross white space, which the tokenizer drops.
RUN, SEPARATORS = re.compile(f"[^{SPACE}]+"), re.compile("[\x1c-\x1f]")
#: Letters and numbers below U+0250. All are in composed form already.
LETTERS, NUMBERS = ("".join(c for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == kind) for kind in "LN")
#: Characters beyond those and general punctuation, and what may begin a special token.
NOT_PLAIN = re.compile(r"[^\x00-\u024f\u2010-\u2027\u2030-\u205e]|<\|")
#: The tokenizer's first split (a fixed pattern), for plain characters; line ends stand between runs.
TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACE}{LETTERS}{NUMBERS}]+|\n")
#: Runs of which a worker remembers so many to twice as many, and characters of the longest of them.
REMEMBERED, LONGEST = 800_000, 32
PIECE = ("doc_id", "piece", "start", "length", "ids_crc32")
#: Rows of one size are dealt out in groups of about this many, or a share of all rows if that is more.
GROUP_ROWS, GROUP_SHARE = 128, 8192


@dataclass(frozen=True)
class BestFit:
    """vocabulary: the tokenizer's file, by default word_bpe_49k.json."""

    window: int = 4096
    end: int = 1
    vocabulary: str | None = None


class Merger:
    """Ids of runs without white space by the tokenizer's first split and its merges. The vocabulary's numbers have to
    ascend with the rank of the merges, which is checked. A blank stands for the end of a word, as no token has one."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix, vocabulary = model["end_of_word_suffix"], model["vocab"]
        numbers = [vocabulary["".join(m if isinstance(m, list) else m.split(" ", 1))] for m in model["merges"]]
        if not suffix or any(a >= b for a, b in pairwise(numbers)) or model["byte_fallback"] or model["ignore_merges"]:
            raise ValueError(f"{path}: not a vocabulary with word ends whose numbers follow its merges")
        # Byte-level vocabularies write bytes that can't be printed as the characters from U+0100 on.
        shown = [b for b in range(256) if chr(b).isprintable() and b != 0x20]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {}
        for token, number in vocabulary.items():
            word = token.removesuffix(suffix)
            if word and all(byte_of.get(c, 0x20) not in b" \n" for c in word):
                ranks[bytes(map(byte_of.__getitem__, word)) + b" " * (word != token)] = number
        self.stop = 1 + max(vocabulary.values())
        ranks |= {b" ": self.stop + 1, b"\n": self.stop + 2, b"\n ": self.stop}
        self.encode = tiktoken.Encoding("words", pat_str="[^ \n]+ |\n ", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, runs: list[str]) -> list[bytes]:
        """For each run of plain characters in lower case."""
        ids = np.array(self.encode(" ".join(TOKEN.findall("\n".join(runs))) + " \n "), dtype="<u4")
        data, ends = ids.tobytes(), (4 * np.flatnonzero(ids == self.stop)).tolist()
        return [data[a:b] for a, b in zip([0, *(e + 4 for e in ends)], ends, strict=False)]


class WordEncoder(dict):
    """Ids of texts, as bytes of little-endian unsigned 32-bit numbers. Runs without white space are looked up once seen;
    those not met again for long are forgotten.

    In a run of plain characters (Latin letters, signs and general punctuation, which the tokenizer's normalisation
    only lower-cases) the tokenizer's first split is taken by its pattern; other runs go to the tokenizer itself.
    """

    def __init__(self, vocabulary: str | None = None):
        import public_tokenizers
        from tokenizers import Tokenizer

        path = vocabulary or public_tokenizers.path("word_bpe_49k.json")
        self.merger = Merger(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.before: dict[str, bytes] = {}

    def _learn(self, runs: set[str]) -> None:
        unknown, before = [], self.before
        for run in runs:
            found = before.get(run)
            if found is None:
                unknown.append(run)
            else:
                self[run] = found
        whole = "\n".join(unknown)
        low = whole.lower().split("\n")
        if NOT_PLAIN.search(whole) or NOT_PLAIN.search("".join(low)):
            plain = [not (NOT_PLAIN.search(run) or NOT_PLAIN.search(x)) for run, x in zip(unknown, low, strict=True)]
            for run in (run for run, ok in zip(unknown, plain, strict=True) if not ok):
                self[run] = np.array(self.tokenizer.encode(run, add_special_tokens=False).ids, dtype="<u4").tobytes()
            unknown, low = ([x for x, ok in zip(y, plain, strict=True) if ok] for y in (unknown, low))
        if unknown:
            self.update(zip(unknown, self.merger.ids(low), strict=True))

    def ids(self, texts: list[str]) -> list[bytes]:
        # str.split also cuts at U+001C to U+001F, which are no white space here.
        runs = [RUN.findall(text) if SEPARATORS.search(text) else text.split() for text in texts]
        flat = list(chain.from_iterable(runs))
        found = list(map(self.get, flat))
        unseen = [i for i, ids in enumerate(found) if ids is None]
        new = {flat[i] for i in unseen}
        self._learn(new)
        for i in unseen:
            found[i] = self[flat[i]]
        ends = list(accumulate(map(len, runs)))
        out = [b"".join(found[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
        for run in [run for run in new if len(run) > LONGEST]:
            del self[run]
        if len(self) > REMEMBERED:
            self.before = dict(self)
            self.clear()
        return out


def pieces(docs: DataFrame, rule: BestFit) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's full windows and what is left of it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(rule.vocabulary)
        end, width = rule.end.to_bytes(4, "little"), 4 * rule.window
        for batch in slices(batches):
            rows, out = [], []
            for row, found in enumerate(encoder.ids([text or "" for text in batch.column(1).to_pylist()])):
                ids = found + end
                for piece, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    rows.append(row)
                    out.append((piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *columns], list(PIECE))

    return docs.selectExpr("cast(doc_id as long) AS doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass
class Sizes:
    """Pieces and gaps by size."""

    pieces: dict[int, int]
    gaps: dict[int, int]

    @classmethod
    def of(cls, left: DataFrame, gaps: DataFrame) -> Sizes:
        counted = left.select(F.lit(0).alias("kind"), F.col("length").alias("size")).unionByName(gaps.select(F.lit(1).alias("kind"), F.col("gap").alias("size"))).groupBy("kind", "size").count()
        found: tuple[dict[int, int], dict[int, int]] = ({}, {})
        for r in counted.collect():  # at most two rows for each size up to the window
            found[r["kind"]][r["size"]] = r["count"]
        return cls(*found)

    def places(self) -> list[tuple[int, int, int, int, int]]:
        """(kind, size, slots of a gap, salts, depth of the size's first piece or slot), in the order of the sweep."""
        longest = max(s for s in self.pieces if s <= max(self.gaps))
        share = max(GROUP_ROWS, (sum(self.pieces.values()) + sum(self.gaps.values())) // GROUP_SHARE)
        slots = {g: max(1, g // longest) for g in self.gaps}
        order = sorted([(s, 0, s) for s in self.pieces] + [(g // slots[g], 1, g) for g in self.gaps])
        depth, out = 0, []
        for _, kind, size in order:
            n = (self.pieces, self.gaps)[kind][size]
            t = slots[size] if kind else 1
            out.append((kind, size, t, -(-n // share), depth))
            depth += -n * t if kind else n
        return out


def sweep(left: DataFrame, gaps: DataFrame, sizes: Sizes) -> DataFrame:
    """Pieces (kind 0) and slots (kind 1) with mate: the piece's sequence, or the length of the slot's piece, if matched."""
    spark = left.sparkSession
    rows = left.withColumns({"kind": F.lit(0), "size": F.col("length"), "sequence_id": F.lit(None).cast("long")}).unionByName(gaps.select(F.lit(1).alias("kind"), F.col("gap").alias("size"), "sequence_id"), allowMissingColumns=True)
    # Two rows for each size up to the window, and with salts GROUP_SHARE more.
    columns = zip(zip(*sizes.places(), strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)
    places = spark.createDataFrame(pa.table([pa.array(c, t) for c, t in columns], names=["kind", "size", "slots", "salts", "first"]))
    dealt = rows.join(F.broadcast(places), ["kind", "size"]).withColumn("salt", F.pmod(F.xxhash64(*PIECE, "sequence_id"), F.col("salts")).cast("int"))
    counts = dealt.groupBy("kind", "size", "salt").agg(F.count("*").alias("n"))
    before = counts.select("kind", "size", "salt", (F.sum("n").over(W.partitionBy("kind", "size").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = dealt.withColumn("rank", F.row_number().over(W.partitionBy("kind", "size", "salt").orderBy(*PIECE, "sequence_id")) - 1).join(F.broadcast(before), ["kind", "size", "salt"])
    slotted = ranked.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    rank = F.col("before") + F.col("rank")
    # Depth after a piece has opened, or before a slot closes.
    depth = F.when(F.col("kind") == 0, F.col("first") + rank + 1).otherwise(F.col("first") - rank * F.col("slots") - F.col("slot"))
    placed = slotted.select("kind", "size", *PIECE, "sequence_id", F.expr("size div slots").alias("reach"), depth.alias("depth"))
    at = W.partitionBy("depth").orderBy("reach", "kind")
    mate = F.when((F.col("kind") == 0) & (F.lead("kind").over(at) == 1), F.lead("sequence_id").over(at)).when((F.col("kind") == 1) & (F.lag("kind").over(at) == 0), F.lag("size").over(at))
    return placed.withColumn("mate", mate).drop("reach", "depth")


def new_gaps(spark: SparkSession, first: int, n: int, window: int) -> DataFrame:
    return spark.range(first, first + n).select(F.col("id").alias("sequence_id"), F.lit(window).cast("long").alias("gap"))


def assign(cut: DataFrame, rule: BestFit) -> DataFrame:
    """The pieces with sequence_id. cut has to be stashed."""
    spark, window = cut.sparkSession, rule.window
    # Ids below 0 for pieces that open a sequence by themselves, from 0 on for the others.
    large = stash(cut.where(F.col("length") * 2 > window).withColumn("sequence_id", -1 - F.monotonically_increasing_id()))
    out = [large]
    left = cut.where(F.col("length") * 2 <= window)
    gaps = large.where(F.col("length") < window).select("sequence_id", (window - F.col("length")).alias("gap"))
    sizes = Sizes.of(left, gaps)
    tokens = sum(s * n for s, n in sizes.pieces.items()) + sum((window - g) * n for g, n in sizes.gaps.items())
    wanted = max(0, -(-tokens // window) - sum(sizes.gaps.values()))
    opened, stored = 0, []
    while sizes.pieces:
        held = max(sizes.gaps, default=0)
        over = sum(s * n for s, n in sizes.pieces.items() if s > held)
        wanted = wanted or -(-over // window)
        if wanted:
            gaps = gaps.unionByName(new_gaps(spark, opened, wanted, window))
            sizes.gaps[window] = sizes.gaps.get(window, 0) + wanted
            opened, wanted = opened + wanted, 0
        least = min(sizes.pieces)
        sizes.gaps = {g: n for g, n in sizes.gaps.items() if g >= least}
        swept = stash(sweep(left, gaps.where(F.col("gap") >= least), sizes))
        out.append(swept.where("kind = 0 AND mate IS NOT NULL").select(*PIECE, F.col("mate").alias("sequence_id")))
        left = swept.where("kind = 0 AND mate IS NULL").select(*PIECE)
        gaps = stash(swept.where("kind = 1").groupBy("sequence_id").agg((F.max("size") - F.coalesce(F.sum("mate"), F.lit(0))).alias("gap")))
        for table in stored:
            release(table)
        stored = [gaps]
        sizes = Sizes.of(left, gaps)
    for table in stored:
        release(table)
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def pack(docs: DataFrame, rule: BestFit | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece."""
    rule = rule or BestFit()
    small_batches(docs.sparkSession)
    placed = assign(stash(pieces(docs, rule)), rule)
    order = W.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "piece", "ids_crc32").rowsBetween(W.unboundedPreceding, 0)
    return placed.withColumn("offset", F.sum("length").over(order) - F.col("length"))
