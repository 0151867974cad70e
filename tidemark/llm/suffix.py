"""Removal of repeated byte strings by enhanced suffix arrays.

Equal strings of `least` bytes have the same least gram (`gram` bytes), so the suffixes that can share such a string are
dealt out by that gram: runs of windows with one least gram travel as fragments, packed by ranges of the gram's hash,
and only grams that a count-min sketch estimates as repeated travel at all. Long runs, as of periodic texts, are cut
into pieces, so no suffix is longer than a few hundred bytes. Each task builds an enhanced suffix array (order and common prefixes) of
the suffixes of its fragments that are left-diverse, scans it with a stack into the tree of common-prefix intervals
and has from it every maximal repeat with all its occurrences.

A gram that is very frequent is split: its windows are dealt out one by one, by a hash of the window. Equal fragments
meet in the task that reads them before anything is shuffled: where their bytes agree, all but the first are covered,
and only the first goes on. So a passage in a third of all documents costs each task one row.

Defined results: null text is empty; strings never reach over the end of a document; equal rows (doc_id and text) are
one document and get the same result; rows that share a doc_id but not the text are separate documents, ordered by a
hash of the text; a null doc_id counts as smaller than any other. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .session import bytes_estimate, doc_id_of, keyed, n_partitions
from .textwords import U64, Hasher, anchored, by_range, mix, raw, same_bytes, slices

GRAM = 32
#: Fragments of a gram that is counted so often are split into single windows.
HOT = 1 << 14
#: Bytes of text that are hashed at a time; each takes about a hundred bytes of memory meanwhile.
SLICE = 1 << 19
#: Bytes of fragments that a task gathers before it sends them; that it sorts at a time; and of text for each range.
FLUSH, CHUNK, RANGE = 1 << 22, 1 << 18, 1 << 22
#: Longer runs of windows with one least gram (periodic texts) are cut into pieces of so many windows.
PIECE = 256
ROW = "part int, did long, th long, start long, n long, docs binary, table binary, keys binary, body binary"
SPAN = "did long, th long, start long, n long"


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes flat[start:start+length] one behind the other, and their offsets."""
    off = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(lengths, out=off[1:])
    return flat[np.repeat(starts - off[:-1], lengths) + np.arange(off[-1])], off


class Fragmenter:
    """Cuts slices of documents into fragments: runs of windows that have one least gram."""

    def __init__(self, least: int):
        self.least, self.gram = least, min(GRAM, least)
        self.byte, self.whole, self.other = Hasher(61), Hasher(62), Hasher(63)

    def anchors(self, batch: pa.RecordBatch):
        off, flat = raw(batch.column(batch.schema.get_field_index("text")))
        values = self.byte.table[flat]
        return off, flat, values, anchored(self.byte.windows(values, self.gram), off, len(flat), self.least, self.gram)

    def fragments(self, batch: pa.RecordBatch, seen: sketch.Sketch):
        """Of repeated grams: byte ranges, keys, owners (document indexes), and the slice itself."""
        off, flat, values, found = self.anchors(batch)
        if not found.valid.any():
            return None
        change = np.flatnonzero((np.diff(found.least) != 0) | (np.diff(found.valid.astype(np.int8)) != 0)) + 1
        begin = np.concatenate([[0], change])
        end = np.concatenate([change, [len(found.least)]])
        keep = found.valid[begin]
        begin, end = begin[keep], end[keep]
        keys = found.least[begin]
        keep = seen.repeated(keys)
        begin, end, keys = begin[keep], end[keep], keys[keep]
        hot = seen.hot(keys)
        if hot.any():
            count = (end - begin)[hot]
            single = np.repeat(begin[hot] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            begin, end = np.concatenate([begin[~hot], single]), np.concatenate([end[~hot], single + 1])
            keys = np.concatenate([keys[~hot], self.whole.ranges(values, single, single + self.least)])
        if not len(begin):
            return None
        pieces = -(-(end - begin) // PIECE)
        place = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin, end, keys = (np.repeat(x, pieces) for x in (begin, end, keys))
        begin = begin + place * PIECE
        end = np.minimum(end, begin + PIECE) + self.least - 1
        ids = self.whole.ranges(values, begin, end), self.other.ranges(values, begin, end)
        return flat, begin, end, keys, np.searchsorted(off, begin, side="right") - 1, off, ids


def _firsts(rows: list[list[np.ndarray]], flat: np.ndarray, ranges: int) -> Iterator[pa.RecordBatch]:
    """Of equal fragments the first goes on, packed with others of its range; the later ones are put down as covered."""
    at, size, key, did, th, start, one, two = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.lexsort((start, th, did, two, one))
    at, size, key, did, th, start, one, two = (x[order] for x in (at, size, key, did, th, start, one, two))
    begins = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (size[1:] != size[:-1]))
    head = np.flatnonzero(begins)[np.cumsum(begins) - 1]
    begins |= ~same_bytes(flat, at, at[head], size)  # hashes only propose
    later = ~begins & ((did != did[head]) | (th != th[head]) | (start != start[head]))
    names = [x.split()[0] for x in ROW.split(", ")]
    spans = merged(did[later], th[later], start[later], size[later])
    n = len(spans[0])
    none = pa.nulls(n, pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array((np.arange(n) % (1 << 20)).astype(np.int32)), *(pa.array(x, pa.int64()) for x in spans), none, none, none, none], names)
    part = ((mix(key) >> U64(32)) * U64(ranges) >> U64(32)).astype(np.int64)
    go = np.flatnonzero(begins)
    go = go[np.argsort(part[go], kind="stable")]
    cuts = np.flatnonzero(np.diff(part[go], prepend=-1) != 0)
    rows_ = []
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(go)], strict=True):
        own = go[a:b]
        docs, owner = np.unique(np.stack([did[own], th[own]], axis=1), axis=0, return_inverse=True)
        table = np.stack([owner.reshape(-1), start[own], size[own]]).astype(np.uint32)
        rows_.append((int(part[own[0]]), docs.tobytes(), table.tobytes(), key[own].tobytes(), gather(flat, at[own], size[own])[0].tobytes()))
    none = pa.nulls(len(rows_), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows_], pa.int32()), none, none, none, none, *(pa.array([r[i] for r in rows_], pa.binary()) for i in (1, 2, 3, 4))], names)


def merged(did: np.ndarray, th: np.ndarray, start: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """The same spans with those of a document that overlap or touch made one."""
    order = np.lexsort((start, th, did))
    did, th, start, end = (x[order] for x in (did, th, start, start + n))
    fresh = np.append(True, (did[1:] != did[:-1]) | (th[1:] != th[:-1]))[: len(did)]
    step = (np.cumsum(fresh) - 1) * (int(end.max(initial=0)) + 1)
    top = np.maximum.accumulate(end + step) - step
    begins = np.flatnonzero(fresh | np.append(True, start[1:] > top[:-1])[: len(did)])
    last = np.append(begins[1:], len(did))[: len(begins)] - 1
    return [did[begins], th[begins], start[begins], top[last] - start[begins]]


def _scatter(least: int, seen, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, known = Fragmenter(least), seen.value
        rows, bodies, n = [], [], 0
        for batch in slices(batches, limit=SLICE):
            found = cutter.fragments(batch, known)
            if found is None:
                continue
            flat, begin, end, keys, owner, off, (one, two) = found
            did, th = (batch.column(batch.schema.get_field_index(c)).to_numpy()[owner] for c in ("did", "th"))
            body, at = gather(flat, begin, end - begin)
            rows.append([at[:-1] + n, end - begin, keys, did, th, begin - off[owner], one, two])
            bodies.append(body)
            n += len(body)
            if n >= FLUSH:
                yield from _firsts(rows, np.concatenate(bodies), ranges)
                rows, bodies, n = [], [], 0
        if rows:
            yield from _firsts(rows, np.concatenate(bodies), ranges)

    return run


class SuffixArray:
    """The enhanced suffix array of the left-diverse suffixes of fragments.

    Of the windows of `least` bytes that stand twice or more, those are left out that one same byte precedes at all
    their occurrences: what they repeat is part of a longer repeat that starts one byte earlier.
    """

    def __init__(self, flat: np.ndarray, off: np.ndarray, least: int, hasher: Hasher):
        self.flat, self.off = flat, off
        n = len(flat)
        ends = np.repeat(off[1:], np.diff(off))
        at = np.flatnonzero(np.arange(n) + least <= ends)
        name = hasher.windows(hasher.table[flat], least)[at]
        order = np.argsort(name, kind="stable")
        name, at = name[order], at[order]
        begins = np.flatnonzero(np.append(True, name[1:] != name[:-1])) if len(at) else np.zeros(0, dtype=np.int64)
        if len(begins):
            left = np.where(at > 0, flat[at - 1], 0).astype(np.int64)
            left[np.isin(at, off)] = 256 + at[np.isin(at, off)]  # nothing precedes it: unlike any other
            size = np.diff(np.append(begins, len(at)))
            diverse = (np.minimum.reduceat(left, begins) != np.maximum.reduceat(left, begins)) & (size > 1)
            at = at[np.repeat(diverse, size)]
        data = flat.tobytes()
        text = {i: data[i:end] for i, end in zip(at.tolist(), ends[at].tolist(), strict=True)}
        self.order = np.array(sorted(text, key=text.__getitem__), dtype=np.int64)
        self.common = self._common(ends[self.order] - self.order)

    def _common(self, length: np.ndarray) -> np.ndarray:
        """Length of the common prefix of each suffix with the one before it in order, eight bytes at a time."""
        out = np.zeros(len(self.order), dtype=np.int64)
        padded = np.append(self.flat, np.zeros(8, dtype=np.uint8))
        words = np.ndarray(len(self.flat) + 1, dtype="<u8", buffer=padded, strides=(1,))
        most = np.minimum(length[1:], length[:-1])
        left, done = np.arange(1, len(self.order)), 0
        while len(left):
            differ = words[self.order[left - 1] + done] ^ words[self.order[left] + done]
            lowest = (differ & (~differ + U64(1))).astype(np.float64)  # a power of two, or 0
            same = np.where(differ > 0, np.log2(np.maximum(lowest, 1)).astype(np.int64) // 8, 8)
            out[left] += np.minimum(same, most[left - 1] - done)
            left = left[(same == 8) & (most[left - 1] > done + 8)]
            done += 8
        return out

    def intervals(self, least: int) -> Iterator[tuple[int, int, int, list[tuple[int, int]]]]:
        """The tree of common-prefix intervals from the leaves up: (length, left, right, inner intervals), where the
        suffixes order[left:right+1] share length bytes, and no more, and no other suffix shares them."""
        stack: list[list] = []  # [length, left, inner]
        common = self.common.tolist() + [0]
        for i in range(1, len(common)):
            left, done = i - 1, None
            while stack and stack[-1][0] > common[i]:
                length, left, inner = stack.pop()
                if done is not None:
                    inner.append(done)
                yield length, left, i - 1, inner
                done = (left, i - 1)
                if stack and stack[-1][0] >= common[i]:
                    stack[-1][2].append(done)
                    done = None
            if common[i] >= least and (not stack or stack[-1][0] < common[i]):
                stack.append([common[i], left, [done] if done else []])

    def maximal_repeats(self, least: int) -> Iterator[tuple[int, list[int]]]:
        """(length, all occurrences) of every repeat of least bytes or more that can be extended neither way."""
        starts = set(self.off.tolist())
        for length, left, right, _ in self.intervals(least):
            found = self.order[left : right + 1].tolist()
            before = {-i - 1 if i in starts else int(self.flat[i - 1]) for i in found}
            if len(before) > 1:
                yield length, sorted(found)

    def covered(self, least: int, rank: np.ndarray) -> Iterator[tuple[int, int]]:
        """(suffix, bytes) that an earlier occurrence (of lesser rank) covers, the most for each suffix.

        In each interval the first occurrence of every inner interval, but for the first of all, repeats to the
        interval's length; so the work follows the size of the tree, not the number of occurrences.
        """
        first: dict[tuple[int, int], int] = {}
        order = self.order.tolist()
        for length, left, right, inner in self.intervals(least):
            heads, at = [], left
            for a, b in inner:
                heads += order[at:a]
                heads.append(first.pop((a, b)))
                at = b + 1
            heads += order[at : right + 1]
            head = min(heads, key=rank.__getitem__)
            first[left, right] = head
            for x in heads:
                if x != head:
                    yield x, length


def _cover(least: int):
    hasher = Hasher(64)
    names = [x.split()[0] for x in SPAN.split(", ")]

    def solve(flat: np.ndarray, size: np.ndarray, did: np.ndarray, th: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
        """Spans of some fragments, which no other fragment shares a window with."""
        off = np.append(0, np.cumsum(size))
        found = SuffixArray(flat, off, least, hasher)
        owner = np.searchsorted(off, found.order, side="right") - 1
        place = start[owner] + found.order - off[owner]
        rank = np.zeros(int(off[-1]), dtype=np.int64)
        rank[found.order[np.lexsort((place, th[owner], did[owner]))]] = np.arange(len(owner))
        spans = np.array(list(found.covered(least, rank)), dtype=np.int64).reshape(-1, 2)
        owner = np.searchsorted(off, spans[:, 0], side="right") - 1
        return merged(did[owner], th[owner], start[owner] + spans[:, 0] - off[owner], spans[:, 1])

    def solved(held: list) -> pa.RecordBatch:
        docs = [np.frombuffer(x[0], dtype=np.int64).reshape(-1, 2) for x in held]
        tables = [np.frombuffer(x[1], dtype=np.uint32).astype(np.int64).reshape(3, -1) for x in held]
        owners = np.concatenate([d[t[0]] for d, t in zip(docs, tables, strict=True)])
        start, size = (np.concatenate([t[i] for t in tables]) for i in (1, 2))
        key, flat = (np.concatenate([np.frombuffer(x[i], dtype=kind) for x in held]) for i, kind in ((2, U64), (3, np.uint8)))
        at = np.cumsum(size) - size
        # Rows that repeat bring the same fragment more than once.
        order = np.lexsort((size, start, owners[:, 1], owners[:, 0], key))
        key, start, size, at, did, th = (x[order] for x in (key, start, size, at, owners[:, 0], owners[:, 1]))
        fresh = np.append(True, (key[1:] != key[:-1]) | (did[1:] != did[:-1]) | (th[1:] != th[:-1]) | (start[1:] != start[:-1]))
        key, start, size, at, did, th = (x[fresh] for x in (key, start, size, at, did, th))
        groups = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        ends = np.append(groups[1:], len(key))
        total = np.append(0, np.cumsum(size))
        a, out = 0, []
        while a < len(key):
            b = int(ends[min(len(ends) - 1, np.searchsorted(total[ends], total[a] + CHUNK))])
            out.append(solve(gather(flat, at[a:b], size[a:b])[0], size[a:b], did[a:b], th[a:b], start[a:b]))
            a = b
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in merged(*(np.concatenate(x) for x in zip(*out, strict=True)))], names)

    return lambda batches: by_range(batches, SPAN, solved)


def repeated_spans(rows: DataFrame, least: int, seen, ranges: int) -> DataFrame:
    """(did, th, start, n): n bytes that occur earlier as well, n at least `least`."""
    scattered = rows.mapInArrow(_scatter(least, seen, ranges), ROW)
    return scattered.repartition("part").sortWithinPartitions("part").mapInArrow(_cover(least), SPAN)


def remove_repeated_strings(docs: DataFrame, least: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), one row for each row of docs."""
    rows = keyed(docs, hashed=False)
    # A gram in about (least - gram + 2) / 2 bytes is an anchor.
    width = sketch.cells_for(2 * bytes_estimate(docs) / (least - min(GRAM, least) + 2))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        cutter = Fragmenter(least)
        for batch in slices(batches, limit=SLICE):
            yield cutter.anchors(batch)[3].hashes

    seen = sketch.build(rows.select("text"), anchors, width, hot=HOT)
    ranges = max(4 * n_partitions(docs.sparkSession), bytes_estimate(docs) // RANGE)
    spans = repeated_spans(rows, least, seen, ranges).groupBy("did", "th").agg(F.collect_list(F.struct("start", "n")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            off, flat = raw(batch.column(1))
            out = []
            for i, found in enumerate(batch.column(2).to_pylist()):
                body = flat[off[i] : off[i + 1]]
                runs = 0
                if found:
                    edge = np.zeros(len(body) + 1, dtype=np.int64)
                    np.add.at(edge, [x["start"] for x in found], 1)
                    np.add.at(edge, [x["start"] + x["n"] for x in found], -1)
                    drop = np.cumsum(edge)[:-1] > 0
                    runs = int(np.count_nonzero(np.diff(drop.astype(np.int8), prepend=0) == 1))
                    body = body[~drop]
                out.append((int(off[i + 1] - off[i]), int(off[i + 1] - off[i]) - len(body), runs, body.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary())))], ["did", "n_bytes", "n_removed", "n_spans", "kept"])

    done = sketch.cut_spans(rows, spans, cut, "did long, n_bytes long, n_removed long, n_spans long, kept binary")
    return done.select(doc_id_of("did").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def digest(docs: DataFrame, least: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeated_strings(docs, least).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def digest_by_hand(texts: list[tuple[int, str | None]], least: int = 100) -> dict[int, tuple[int, int, int, str]]:
    """The same by brute force over (doc_id, text) with different doc_ids, for tests."""
    seen, out = set(), {}
    for doc_id, text in sorted(texts):
        body = (text or "").encode()
        drop = [False] * len(body)
        for i in range(len(body) - least + 1):
            if body[i : i + least] in seen:
                drop[i : i + least] = [True] * least
            seen.add(body[i : i + least])
        kept = bytes(b for b, d in zip(body, drop, strict=True) if not d)
        out[doc_id] = (len(body), sum(drop), sum(d and not (i and drop[i - 1]) for i, d in enumerate(drop)), hashlib.sha256(kept).hexdigest())
    return out
