"""Connected components of large graphs by alternating stars, each with a local spanning forest.

A round is a grouped minimum, a join on its key and edges dealt out by their greater ends; no adjacency list is ever
gathered, and tasks drop what is double, so no step is there for that alone. Rounds end in written tables, so a lost
executor costs no more than a step. Hubs are safe: their minimum is combined before the shuffle, in the join the nodes
with far more edges than others, which are boundedly few, are broadcast, and of the edges to lesser nodes a task sends
one a node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import join_unique, release, stash

CHUNK = 1 << 19


def _forest(batches: Iterator[pa.RecordBatch], chunk: int, whole: bool = False) -> Iterator[pa.RecordBatch]:
    """Replaces the edges that a task has, in chunks, by stars around the least node of each of their components; there
    are never more of these. With whole the edges come in order of u, and those of one u are in one chunk."""
    held: list[np.ndarray] = []
    n = 0

    def stars(edges: np.ndarray) -> pa.RecordBatch:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while (up := root.setdefault(top, top)) != top:
                top = up
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        edges = edges[np.lexsort((edges[:, 1], edges[:, 0]))]
        fresh = np.append(True, (np.diff(edges, axis=0) != 0).any(axis=1))
        for a, b in edges[fresh].tolist():
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        pairs = [(x, y) for x in root if (y := find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["u", "v"])

    for batch in batches:
        if batch.num_rows:
            held.append(np.stack([c.to_numpy() for c in batch.columns], axis=1))
            n += batch.num_rows
        if n >= chunk:
            edges = np.concatenate(held)
            cut = int(np.searchsorted(edges[:, 0], edges[-1, 0])) if whole else n
            if cut:
                yield stars(edges[:cut])
            held, n = [edges[cut:]], n - cut
    if n:
        yield stars(np.concatenate(held))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (two long columns), a written table; component is the least node
    reachable.

    Edges may be there more than once. Self-loops count for nothing and nulls are left out; an empty table gives an
    empty one.
    """
    a, b = edges.columns
    chunk = CHUNK
    star = "u long, v long"

    def dealt(found: DataFrame) -> DataFrame:
        """A hub has one edge a task left when the edges are dealt out by their greater ends, where lesser ones meet."""
        sent = found.mapInArrow(lambda batches: _forest(batches, chunk), star)
        return stash(sent.repartition("u").sortWithinPartitions("u").mapInArrow(lambda batches: _forest(batches, chunk, whole=True), star))

    # Written first, few edges from many partitions are read by few tasks, whose forests drop more of them.
    given = stash(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")))
    found = dealt(given)
    release(given)
    while True:
        # Of each node the least and the greatest of its lesser neighbours, and how many edges it has to greater ones.
        ends = found.select(F.col("u").alias("node"), "v", F.lit(0).alias("n")).union(found.select("v", F.lit(None).cast("long"), F.lit(1)))
        ends = stash(ends.groupBy("node").agg(F.min("v").alias("m"), F.max("v").alias("most"), F.sum("n").alias("n")))
        # Is this a forest of stars? Then no centre has an edge to a lesser node, and every other node has one centre.
        if ends.where("most > m OR m IS NOT NULL AND n > 0").isEmpty():
            break
        # A node's greater neighbours go on to the least of its lesser ones.
        centres = ends.where("n > 0").select(F.col("node").alias("v"), "m", "n")
        last, found = found, dealt(join_unique(found, centres, "v", "n").select("u", F.coalesce("m", "v").alias("v")))
        release(last)
        release(ends)
    release(found)
    return ends.select("node", F.coalesce("m", "node").alias("component"))
