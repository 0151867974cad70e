"""Count-min sketches of 64-bit keys, built per partition, merged by Spark, read back as two bitmaps.

A sketch has two rows of counters. Each task counts its keys and sends the cells it touched; cells are merged by
ranges, and only two bits a cell return: "counted at least `least`" and "counted at least `hot`". A key's estimate is
the lesser of its two cells, never below its true count, so a key that is counted often enough is never missed. The
number of cells follows the input up to a fixed most, which bounds what is broadcast; beyond it more keys merely
pass the filter.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import n_partitions, stash
from .textwords import U64, mix

#: Cells of a row. Two rows of a bit (two, with `hot`): 2 * 2**27 / 8 = 32 MiB (64 MiB) broadcast at most.
LEAST_CELLS, MOST_CELLS = 1 << 14, 1 << 27
#: Cells that are merged together.
RANGE = 1 << 20
#: Keys that a task gathers before it sends the cells.
FLUSH = 1 << 19
SCHEMA = "part int, cells binary, counts binary"


def cells_for(keys: float, per_key: float = 4.0) -> int:
    """Cells of a row for about so many keys, a multiple of eight within the bounds."""
    return min(MOST_CELLS, max(LEAST_CELLS, int(keys * per_key))) // 8 * 8


def cells_of(keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A key's cell in each row; the second row's cells lie behind the first's."""
    half = U64(32)
    return ((keys >> half) * U64(width) >> half).astype(np.int64), ((mix(keys) >> half) * U64(width) >> half).astype(np.int64) + width


def _send(keys: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    cells, counts = np.unique(np.concatenate(cells_of(keys, width)), return_counts=True)
    part = cells // RANGE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(cells)]
    rows = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            steps = np.diff(cells[a:b], prepend=part[a] * RANGE).astype(np.uint32)
            rows.append((int(part[a]), zlib.compress(steps.tobytes(), 1), zlib.compress(counts[a:b].astype(np.uint32).tobytes(), 1)))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["part", "cells", "counts"])


class Sketch:
    """The merged sketch as it is read: packed bits of both rows."""

    def __init__(self, width: int, repeated: np.ndarray, hot: np.ndarray | None):
        self.width, self._repeated, self._hot = width, repeated, hot

    @staticmethod
    def _test(packed: np.ndarray, cells: np.ndarray) -> np.ndarray:
        return (packed[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 > 0

    def _both(self, packed: np.ndarray, keys: np.ndarray) -> np.ndarray:
        a, b = cells_of(keys, self.width)
        return self._test(packed, a) & self._test(packed, b)

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        """True for every key that was counted at least `least` times, and for some others."""
        return self._both(self._repeated, keys)

    def hot(self, keys: np.ndarray) -> np.ndarray:
        """True for every key that was counted at least `hot` times, and for some others."""
        return self._both(self._hot, keys)


def build(rows: DataFrame, keys_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], width: int, least: int = 2, hot: int | None = None) -> Broadcast:
    """Count the keys that keys_of yields for each task's batches and broadcast the merged Sketch."""
    spark = rows.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for keys in keys_of(batches):
            held.append(keys)
            n += len(keys)
            if n >= FLUSH:
                yield from _send(np.concatenate(held), width)
                held, n = [], 0
        if n:
            yield from _send(np.concatenate(held), width)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, cells, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = np.cumsum(np.frombuffer(zlib.decompress(cells), dtype=np.uint32).astype(np.int64))
                sums.setdefault(part, np.zeros(RANGE, dtype=np.int64))[at] += np.frombuffer(zlib.decompress(counts), dtype=np.uint32)
        for part, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([zlib.compress(np.packbits(total >= bound).tobytes(), 1)], pa.binary()) for bound in (least, hot or 1 << 62))], ["part", "cells", "counts"])

    parts = -(-2 * width // RANGE)
    # One partition for each range or fewer: what a task holds is bounded by the ranges it gets.
    sent = rows.mapInArrow(count, SCHEMA).repartition(max(1, min(parts, n_partitions(spark))), "part").mapInArrow(merge, SCHEMA)
    repeated = np.zeros(parts * RANGE // 8, dtype=np.uint8)
    found_hot = None if hot is None else repeated.copy()
    # The bitmaps are bounded, and collected by one job; an iterator would run one for each partition, empty ones too.
    for part, a, b in sent.select(F.col("part"), F.col("cells"), F.col("counts")).collect():
        at = slice(part * RANGE // 8, (part + 1) * RANGE // 8)
        repeated[at] = np.frombuffer(zlib.decompress(bytes(a)), dtype=np.uint8)
        if found_hot is not None:
            found_hot[at] = np.frombuffer(zlib.decompress(bytes(b)), dtype=np.uint8)
    return spark.sparkContext.broadcast(Sketch(width, repeated, found_hot))


def counted(column: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]:
    """For keys that stand in a long column."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            yield batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)

    return keys


def parted(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows without any of the keys, and the others, which have them all and some more.

    rows and keys have a long column __k. The keys come as a bitmap, so neither part is shuffled.
    """
    known = build(keys.select("__k"), counted("__k"), cells_for(keys.count(), per_key=8), least=1)
    at = rows.columns.index("__k")

    def kept(inside: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = known.value.repeated(batch.column(at).to_numpy().view(U64))
                yield batch.filter(pa.array(found if inside else ~found))

        return run

    return rows.mapInArrow(kept(False), rows.schema), rows.mapInArrow(kept(True), rows.schema)


def cut_spans(rows: DataFrame, spans: DataFrame, cut: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """cut over the rows (did, th, text) with their spans (did, th, spans), as columns did, text, spans.

    Texts that a bitmap of the spans' documents rules out are cut where they are read; only the others are shuffled.
    """
    spans = stash(spans)
    plain, touched = parted(rows.select("did", "th", "text", F.xxhash64("did", "th").alias("__k")), spans.select(F.xxhash64("did", "th").alias("__k")))
    none = F.lit(None).cast("array<struct<start:bigint,n:bigint>>").alias("spans")
    joined = touched.join(spans, ["did", "th"], "left").select("did", "text", "spans")
    return plain.select("did", "text", none).mapInArrow(cut, schema).union(joined.mapInArrow(cut, schema))
