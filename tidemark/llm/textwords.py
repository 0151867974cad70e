"""Vectorised hashing of words and windows in Arrow string columns.

A word is a maximal run of bytes other than U+0020 and U+0009 to U+000D. UTF-8 keeps those bytes out of longer
characters, so words of bytes and words of characters agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
FULL = U64(0xFFFFFFFFFFFFFFFF)
#: Texts are worked on in slices of about this many bytes; one longer text is a slice by itself.
SLICE_BYTES = 1 << 20

IS_BLANK = np.zeros(256, dtype=bool)
IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True
IS_WORD = ~IS_BLANK


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n 64-bit integers that look random."""
    with np.errstate(over="ignore"):
        return mix(U64(seed) + U64(0x9E3779B97F4A7C15) * np.arange(1, n + 1, dtype=U64))


class Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, grown as needed."""

    def __init__(self, seed: int):
        self.base = int(stream(seed, 1)[0]) | 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << max(16, (n - 1).bit_length())
            self.up, self.down = (_powers(b, size) for b in (self.base, self.inverse))
        return self.up, self.down


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=U64)
    done = 1
    with np.errstate(over="ignore"):
        while done < n:
            step = U64(pow(base, done, 1 << 64))
            out[done : 2 * done] = out[:done][: n - done] * step
            done *= 2
    return out


class Hasher:
    """Polynomial hashes of sub-ranges of a sequence, from one running sum."""

    def __init__(self, seed: int):
        self.table = stream(seed ^ 0xB17E, 256)
        self.folded = self.table.copy()
        self.folded[ord("A") : ord("Z") + 1] = self.table[ord("a") : ord("z") + 1]
        self.powers = Powers(seed)

    def _running(self, values: np.ndarray) -> np.ndarray:
        up, _ = self.powers.get(len(values) + 1)
        out = np.zeros(len(values) + 1, dtype=U64)
        with np.errstate(over="ignore"):
            np.cumsum(values * up[: len(values)], out=out[1:])
        return out

    def ranges(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of values[start:end]."""
        running = self._running(values)
        _, down = self.powers.get(len(values) + 1)
        with np.errstate(over="ignore"):
            return mix((running[ends] - running[starts]) * down[starts])

    def windows(self, values: np.ndarray, k: int) -> np.ndarray:
        """Hashes of values[i:i+k] for every i that has k values left."""
        if len(values) < k:
            return np.zeros(0, dtype=U64)
        running = self._running(values)
        _, down = self.powers.get(len(values) + 1)
        with np.errstate(over="ignore"):
            return mix((running[k:] - running[:-k]) * down[: len(values) - k + 1])


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string or binary column, nulls as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return off - off[0], flat


def same_bytes(flat: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """Whether flat[a:a+length] equals flat[b:b+length], for arrays of places and lengths above 0."""
    out = np.zeros(len(a), dtype=bool)
    total = np.cumsum(lengths)
    at = 0
    while at < len(a):
        end = max(at + 1, int(np.searchsorted(total, total[at] - lengths[at] + step, side="right")))
        n = lengths[at:end]
        begins = np.cumsum(n) - n
        reach = np.arange(int(n.sum())) - np.repeat(begins, n)
        out[at:end] = np.logical_and.reduceat(flat[np.repeat(a[at:end], n) + reach] == flat[np.repeat(b[at:end], n) + reach], begins)
        at = end
    return out


def by_range(batches: Iterator[pa.RecordBatch], schema: str, work: Callable[[list[list[pa.Buffer]]], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of part: those without packed columns (from the fifth on) as they are, without part; of each part
    what work makes of the packed columns of its rows."""
    names = [x.split()[0] for x in schema.split(", ")]
    part, held = None, []
    for batch in batches:
        packed = batch.column(len(names) + 1).is_valid()
        plain = pa.RecordBatch.from_arrays(batch.columns[1 : len(names) + 1], names).filter(pc.invert(packed))
        if plain.num_rows:
            yield plain
        for i in np.flatnonzero(packed.to_numpy(zero_copy_only=False)).tolist():
            if held and batch.column(0)[i].as_py() != part:
                yield work(held)
                held = []
            part = batch.column(0)[i].as_py()
            held.append([c[i].as_buffer() for c in batch.columns[len(names) + 1 :]])
    if held:
        yield work(held)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """The batches in row ranges of about limit bytes of text, and of at most rows rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        part = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            for at in range(a, b, rows):
                yield batch.slice(at, min(rows, b - at))


@dataclass
class Words:
    """Words of a slice: byte ranges, and where each document's words begin (one more entry than documents)."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def find_words(off: np.ndarray, flat: np.ndarray) -> Words:
    n = len(flat)
    word = IS_WORD[flat]
    begins, stops = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    stops[:-1] &= ~word[1:]
    at = off[:-1][off[:-1] < n]
    begins[at] = word[at]
    before = at[at > 0] - 1
    stops[before] = word[before]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(starts, ends, np.searchsorted(starts, off))


def word_hashes(column: pa.Array, hasher: Hasher, fold: bool = False) -> tuple[Words, np.ndarray]:
    """Words of a column and their hashes; fold treats A-Z as a-z."""
    off, flat = raw(column)
    words = find_words(off, flat)
    return words, hasher.ranges((hasher.folded if fold else hasher.table)[flat], words.starts, words.ends)


def slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op (np.minimum or np.maximum) over every run of width values."""
    done, out = 1, x
    while done * 2 <= width:
        out = op(out[:-done], out[done:])
        done *= 2
    return op(out[: len(x) - width + 1], out[width - done : width - done + len(x) - width + 1]) if done < width else out


@dataclass
class Anchored:
    """Windows of a slice. least: for each start the window's least gram hash (FULL where no window starts);
    anchors: the positions of grams that are least in some window, and their hashes."""

    least: np.ndarray
    valid: np.ndarray
    anchors: np.ndarray
    hashes: np.ndarray


def anchored(grams: np.ndarray, first: np.ndarray, n: int, window: int, k: int) -> Anchored:
    """The least gram of each window of a concatenation of documents.

    grams[i] is the hash of the k items at i; document d holds items first[d]:first[d+1] of n. Equal windows have
    equal least grams, so comparing windows only where least grams agree loses none.
    """
    if n < window:
        none = np.zeros(0, dtype=U64)
        return Anchored(none, np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64), none)
    span = window - k + 1
    least = slide(grams, span, np.minimum)
    owner_end = np.repeat(first[1:], np.diff(first))
    valid = np.arange(n - window + 1) + window <= owner_end[: n - window + 1]
    # A gram is an anchor if it equals the greatest of the least grams of the valid windows around it.
    padded = np.zeros(len(grams) + span - 1, dtype=U64)
    padded[span - 1 : span - 1 + len(least)] = np.where(valid, least, U64(0))
    anchors = np.flatnonzero((slide(padded, span, np.maximum) == grams) & (grams > 0))
    return Anchored(np.where(valid, least, FULL), valid, anchors, grams[anchors])
