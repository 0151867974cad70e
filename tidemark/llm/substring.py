"""Removal of repeated passages of words, with a count-min prefilter.

A window is `window` consecutive words. First pass: every window's count is overestimated by the count of its least
gram (`gram` words), which equal windows share; partition sketches of those grams are merged. Second pass: only
windows estimated as repeated are grouped, by 96 bits of hashes over 64-bit hashes of their words: windows that differ
pass as equal once in 2**96 pairs, or once in 2**64 where they differ in words alone whose hashes are equal. Windows
travel packed by ranges of their least gram's hash, neighbours together; those of a very frequent gram one by one.
Within a task later copies of a window are marked at once and only the first goes on, so a passage in a third of all
documents costs each task one window.

Defined results: null text is empty; texts with fewer words than the window lose nothing; equal rows (doc_id and text)
are one document and get the same result; rows that share a doc_id but not the text are separate documents,
ordered by a hash of the text; a null doc_id counts as smaller than any other. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .session import bytes_estimate, doc_id_of, keyed, n_partitions
from .textwords import U64, Hasher, anchored, by_range, mix, slices, word_hashes

#: Windows that a task gathers before it marks later copies and sends the rest.
FLUSH = 1 << 17
#: At most about so many windows are grouped at a time.
RANGE = 1 << 20
#: Windows whose least gram is counted so often are dealt out one by one.
HOT = 1 << 13
SENT = "part int, did long, th long, start long, n long, docs binary, runs binary, one binary, two binary"
SPAN = "did long, th long, start long, n long"


@dataclass
class Windows:
    """Some windows: two hashes of the words, the document's rank among docs (did, th in order) and the start."""

    one: np.ndarray
    two: np.ndarray
    rank: np.ndarray
    start: np.ndarray
    docs: np.ndarray

    @classmethod
    def of(cls, one, two, did, th, start) -> Windows:
        order = np.lexsort((th, did))
        did, th = did[order], th[order]
        fresh = np.append(True, (did[1:] != did[:-1]) | (th[1:] != th[:-1]))[: len(did)]
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.cumsum(fresh) - 1
        return cls(one, two, rank, start, np.stack([did[fresh], th[fresh]], axis=1))

    def firsts(self) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the first window of each group of equal ones, and of all that start later than theirs."""
        order = np.lexsort((self.start, self.rank, self.two, self.one))
        one, two, rank, start = (x[order] for x in (self.one, self.two, self.rank, self.start))
        begins = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))[: len(one)]
        head = np.flatnonzero(begins)[np.cumsum(begins) - 1]
        return order[begins], order[(rank != rank[head]) | (start != start[head])]

    def runs(self, at: np.ndarray, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """at in order of part, document and start; where runs of windows one behind the other begin; their lengths."""
        part = np.zeros(len(self.start), dtype=np.int64) if part is None else part
        at = at[np.lexsort((self.start[at], self.rank[at], part[at]))]
        p, r, s = part[at], self.rank[at], self.start[at]
        begins = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (r[1:] != r[:-1]) | (s[1:] > s[:-1] + 1))[: len(at)])
        ends = np.append(begins[1:], len(at))[: len(begins)] - 1
        return at, begins, s[ends] - s[begins] + 1

    def spans(self, at: np.ndarray) -> list[np.ndarray]:
        """did, th, start, n of the runs of the windows at."""
        at, begins, n = self.runs(at)
        docs = self.docs[self.rank[at[begins]]].reshape(-1, 2)
        return [docs[:, 0], docs[:, 1], self.start[at[begins]], n]


def _window_state(window: int, gram: int):
    word, one, two = Hasher(11), Hasher(12), Hasher(13)

    def of(batch: pa.RecordBatch):
        words, h = word_hashes(batch.column(batch.schema.get_field_index("text")), word)
        grams = one.windows(h, gram)
        return words, h, anchored(grams, words.first, len(h), window, gram), one, two

    return of


def _mark(window: int, gram: int, seen, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, known = _window_state(window, gram), seen.value
        held, n = [], 0
        for batch in slices(batches):
            words, h, found, one, two = state(batch)
            at = np.flatnonzero(found.valid)
            at = at[known.repeated(found.least[at])]
            if len(at):
                owner = np.searchsorted(words.first, at, side="right") - 1
                did, th = (batch.column(batch.schema.get_field_index(c)).to_numpy()[owner] for c in ("did", "th"))
                key, first = found.least[at], one.windows(h, window)[at]
                part = (mix(np.where(known.hot(key), first, key)) >> U64(32)) * U64(ranges) >> U64(32)
                held.append((first, (two.windows(h, window)[at] >> U64(32)).astype(np.uint32), did, th, at - words.first[owner], part.astype(np.int64)))
                n += len(at)
            if n >= FLUSH:
                yield from _marked(held)
                held, n = [], 0
        if n:
            yield from _marked(held)

    return run


def _marked(held: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Of each window the first in order goes on, packed with others of its range; the later ones are put down as runs
    of n windows, which need no further comparison."""
    *columns, part = (np.concatenate(x) for x in zip(*held, strict=True))
    found = Windows.of(*columns)
    first, later = found.firsts()
    at, begins, n = found.runs(first, part)
    cuts = np.flatnonzero(np.diff(part[at[begins]], prepend=-1) != 0)
    rows = []
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(begins)], strict=True):
        runs = begins[a:b]
        docs, owner = np.unique(found.rank[at[runs]], return_inverse=True)
        own = at[runs[0] : begins[b] if b < len(begins) else len(at)]
        table = np.stack([owner, found.start[at[runs]], n[a:b]]).astype(np.uint32)
        rows.append((int(part[own[0]]), found.docs[docs].tobytes(), table.tobytes(), found.one[own].tobytes(), found.two[own].tobytes()))
    none = pa.nulls(len(rows), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), none, none, none, none, *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3, 4))], [x.split()[0] for x in SENT.split(", ")])
    spans = found.spans(later)
    none = pa.nulls(len(spans[0]), pa.binary())
    spread = pa.array((np.arange(len(spans[0])) % (1 << 20)).astype(np.int32))
    yield pa.RecordBatch.from_arrays([spread, *(pa.array(x, pa.int64()) for x in spans), none, none, none, none], [x.split()[0] for x in SENT.split(", ")])


def _later(held: list[list[pa.Buffer]]) -> pa.RecordBatch:
    """Of a range's windows those that equal an earlier one, as runs."""
    did, th, start = [], [], []
    for docs, runs, _, _ in held:
        docs = np.frombuffer(docs, dtype=np.int64).reshape(-1, 2)
        owner, begin, n = np.frombuffer(runs, dtype=np.uint32).astype(np.int64).reshape(3, -1)
        owner = np.repeat(owner, n)
        did.append(docs[owner, 0])
        th.append(docs[owner, 1])
        start.append(np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum()))
    one, two = (np.concatenate([np.frombuffer(x[i], dtype=kind) for x in held]) for i, kind in ((2, U64), (3, np.uint32)))
    found = Windows.of(one, two, *map(np.concatenate, (did, th, start)))
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found.spans(found.firsts()[1])], [x.split()[0] for x in SPAN.split(", ")])


def repeated_windows(rows: DataFrame, window: int, gram: int, seen, ranges: int) -> DataFrame:
    """(did, th, start, n): runs of n windows, each with an equal window that starts earlier."""
    sent = rows.mapInArrow(_mark(window, gram, seen, ranges), SENT)
    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(lambda batches: by_range(batches, SPAN, _later), SPAN)


def remove_repeated_passages(docs: DataFrame, window: int = 20, gram: int = 8) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the remaining words joined by one space), one row for each row of docs."""
    rows = keyed(docs, hashed=False)
    # A gram in about (window - gram + 2) / 2 words is an anchor, and a word has about 6 bytes.
    width = sketch.cells_for(bytes_estimate(docs) / (3 * (window - gram + 2)))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        state = _window_state(window, gram)
        for batch in slices(batches):
            yield state(batch)[2].hashes

    seen = sketch.build(rows.select("text"), anchors, width, hot=HOT)
    ranges = max(4 * n_partitions(docs.sparkSession), bytes_estimate(docs) // (6 * RANGE))
    spans = repeated_windows(rows, window, gram, seen, ranges).groupBy("did", "th").agg(F.collect_list(F.struct("start", "n")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple] = []
            texts, spans_ = batch.column(1), batch.column(2)
            for text, found in zip(texts.to_pylist(), spans_.to_pylist(), strict=True):
                words = text.encode().split()
                kept = words
                if found:
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(edge, [x["start"] for x in found], 1)
                    np.add.at(edge, [x["start"] + x["n"] + window - 1 for x in found], -1)
                    kept = [w for w, drop in zip(words, np.cumsum(edge)[:-1].tolist(), strict=True) if not drop]
                out.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("did")), *(pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string())))], ["did", "n_words", "n_removed", "kept"])

    done = sketch.cut_spans(rows, spans, cut, "did long, n_words long, n_removed long, kept string")
    return done.select(doc_id_of("did").alias("doc_id"), "n_words", "n_removed", "kept")


def digest(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return remove_repeated_passages(docs, window).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def digest_by_hand(texts: list[tuple[int, str | None]], window: int = 20) -> dict[int, tuple[int, int, str]]:
    """The same by brute force over (doc_id, text) with different doc_ids, for tests."""
    seen, out = set(), {}
    for doc_id, text in sorted(texts):
        words = (text or "").encode().split()
        drop = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                drop[i : i + window] = [True] * window
            seen.add(key)
        kept = b" ".join(w for w, d in zip(words, drop, strict=True) if not d)
        out[doc_id] = (len(words), sum(drop), hashlib.sha256(kept).hexdigest())
    return out

