"""Packing of tokenised documents into sequences by non-negative least squares over a histogram of lengths.

Documents are cut into full windows and a remainder. Lengths are binned (`unit` tokens, rounded up), and their histogram,
whose size is fixed, comes to the driver. There all combinations of at most `depth` bins that fill a window are
enumerated, non-negative least squares gives how often each is used, the counts are rounded and what is left is packed
greedily, all on counts, never on documents. The plan, of bounded size, goes back: a piece's rank among the pieces of
its bin says which sequence and which place in it the piece gets.

Ranks are counted in two steps, by bin and a hash, so a bin with a third of all pieces is no task of its own.

Defined results: null text is empty and gives the end token alone; each row is packed, also repeated ones; a null doc_id
is carried along; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .session import stash
from .textwords import slices

#: Unicode white space, as the tokenizer's pattern has it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Text is tokenised by chunks that no token crosses; equal chunks have equal ids.
CHUNK = re.compile(f"[{SPACE}]+(?![^{SPACE}])| ?[^{SPACE}]+|[{SPACE}]")
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Chunks whose ids a worker remembers.
REMEMBERED = 300_000


@dataclass(frozen=True)
class Packing:
    """ranks: the byte-level BPE vocabulary as ranks, by default that of byte_bpe_50k. added: a text's added_tokens of
    byte_bpe_50k.json, such as <|endoftext|>, get their own ids, as tokenizers reads them, and are not plain text."""

    window: int = 2048
    unit: int = 8
    depth: int = 3
    end: int = 1
    ranks: str | None = None
    salts: int = 256
    added: bool = False


class ChunkEncoder:
    """Token ids of texts; chunks seen before are looked up."""

    def __init__(self, ranks: str | None, added: bool = False):
        import base64
        import json

        import public_tokenizers
        import tiktoken

        path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
        with open(path, "rb") as f:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.known: dict[str, list[int]] = {}
        self.added: dict[str, int] = {}
        if added:
            with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
                self.added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        # Longer ones first, as one may begin another.
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None

    def ids(self, text: str) -> list[int]:
        if self.split is None:
            return self._plain(text)
        plain, *rest = self.split(text)
        out = self._plain(plain)
        for token, plain in zip(rest[::2], rest[1::2], strict=True):
            out.append(self.added[token])
            out += self._plain(plain)
        return out

    def _plain(self, text: str) -> list[int]:
        known, out = self.known, []
        extend = out.extend
        for chunk in CHUNK.findall(text):
            found = known.get(chunk)
            if found is None:
                found = self.encode(chunk)
                if len(chunk) <= 32:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[chunk] = found
            extend(found)
        return out


def pieces(docs: DataFrame, rule: Packing) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each document's full windows and its remainder."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(rule.ranks, rule.added)
        for batch in slices(batches):
            out = []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = np.array([*encoder.ids(text or ""), rule.end], dtype="<u4")
                for start in range(0, len(ids), rule.window):
                    part = ids[start : start + rule.window]
                    out.append((row, start, len(part), zlib.crc32(part.tobytes()), len(ids)))
            found = np.array(out, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found[:, 0])), *(pa.array(found[:, i]) for i in range(1, 5))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.selectExpr("cast(doc_id as long) AS doc_id", "text").mapInArrow(cut, PIECE)


def combinations(bins: int, depth: int) -> np.ndarray:
    """All multisets of at most depth bins whose sum is bins, as rows padded by 0, in descending order."""
    found = [(bins,)] if depth else []
    stack = [((), bins, bins)]
    out = []
    while stack:
        taken, rest, most = stack.pop()
        if not rest:
            out.append(taken + (0,) * (depth - len(taken)))
        elif len(taken) < depth:
            least = -(-rest // (depth - len(taken)))
            stack += [((*taken, b), rest - b, b) for b in range(least, min(most, rest) + 1)]
    return np.array(sorted(out) if found else [], dtype=np.int64)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """x >= 0 with least |a x - b|, by the active-set method of Lawson and Hanson."""
    x = np.zeros(a.shape[1])
    active: list[int] = []
    scale = max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= 1e-7 * scale:
            break
        active.append(best)
        while True:
            sub = a[:, active]
            y = np.linalg.lstsq(sub.T @ sub + 1e-9 * np.eye(len(active)), sub.T @ b, rcond=None)[0]
            if y.min() > 0:
                break
            now = x[active]
            low = y <= 0
            step = float(np.min(now[low] / np.maximum(now[low] - y[low], 1e-300)))
            now = now + step * (y - now)
            x[:] = 0
            x[active] = now
            left = [i for i, v in zip(active, now, strict=True) if v > 1e-12]
            if left == active:
                left = [i for i, v in zip(active, y, strict=True) if v > 0]
            x[[i for i in active if i not in left]] = 0
            active = left
            if not active:
                break
        x[:] = 0
        if active:
            x[active] = y[: len(active)]
    return x


def plan(histogram: dict[int, int], rule: Packing) -> list[tuple[list[int], int]]:
    """(bins of a sequence, repeats), which together use every piece of the histogram (by bin) once."""
    bins = rule.window // rule.unit
    left = np.zeros(bins + 1, dtype=np.int64)
    for b, n in histogram.items():
        left[b] = n
    out = [([bins], int(left[bins]))] if left[bins] else []
    left[bins] = 0
    rows = combinations(bins, rule.depth)
    rows = rows[(rows[:, 0] < bins) & ((rows == 0) | (left[rows] > 0)).all(axis=1)]
    if len(rows):
        a = np.zeros((bins + 1, len(rows)))
        for column in rows.T:
            np.add.at(a, (column, np.arange(len(rows))), column > 0)
        x = nnls(a, left.astype(float))
        for i in np.argsort(-x, kind="stable").tolist():
            if x[i] < 0.5:
                break
            used = [int(b) for b in rows[i] if b]
            n = min([round(float(x[i])), *(int(left[b]) // used.count(b) for b in set(used))])
            if n > 0:
                np.subtract.at(left, used, n)
                out.append((used, n))
    while left.any():  # the longest first, each followed by the longest that fit
        space, used = bins, []
        for b in np.flatnonzero(left)[::-1].tolist():
            n = min(int(left[b]), space // b)
            used += [b] * n
            space -= n * b
        n = min(int(left[b]) // used.count(b) for b in set(used))
        np.subtract.at(left, used, n)
        out.append((used, n))
    return out


def pack(docs: DataFrame, rule: Packing | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece."""
    rule = rule or Packing()
    cut = stash(pieces(docs, rule).withColumn("bin", F.ceil(F.col("length") / rule.unit).cast("int")).withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"), F.lit(rule.salts)).cast("int")))
    counts = stash(cut.groupBy("bin", "salt").agg(F.count("*").alias("n")))
    # At most window / unit * salts rows, whatever the input.
    before = counts.select("bin", "salt", (F.sum("n").over(W.partitionBy("bin").orderBy("salt")) - F.col("n")).alias("before"))
    histogram = {r["bin"]: r["n"] for r in counts.groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    # For each place of each kind of sequence: the first rank of its bin that it takes, and its first sequence.
    ranges: list[tuple[int, int, int, int]] = []
    used = dict.fromkeys(histogram, 0)
    sequence = 0
    for bins, n in plan(histogram, rule):
        for place, b in enumerate(bins):
            ranges.append((b, used[b], sequence, place))
            used[b] += n
        sequence += n
    ranges.sort()
    keys = np.array([(b << 44) | low for b, low, _, _ in ranges], dtype=np.int64)
    first, places = (np.array([r[i] for r in ranges], dtype=np.int64) for i in (2, 3))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bin_, rank = batch.column(5).to_numpy().astype(np.int64), batch.column(6).to_numpy()
            at = np.searchsorted(keys, (bin_ << 44) | rank, side="right") - 1
            found = [pa.array(first[at] + rank - (keys[at] & ((1 << 44) - 1))), pa.array(places[at])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *found], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "place"])

    within = F.row_number().over(W.partitionBy("bin", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens"))
    ranked = cut.withColumn("within", within).join(F.broadcast(before), ["bin", "salt"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin", (F.col("before") + F.col("within") - 1).cast("long").alias("rank"))
    placed = ranked.mapInArrow(assign, f"{PIECE}, sequence_id long, place long")
    offset = F.sum("length").over(W.partitionBy("sequence_id").orderBy("place")) - F.col("length")
    return placed.withColumn("offset", offset).drop("place")
