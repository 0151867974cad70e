"""Exact top-k search by inner product with M-trees.

Inner products become distances by one more coordinate: with x' = (x, sqrt(M - |x|^2)) and q' = (q, 0),
|q' - x'|^2 = |q|^2 + M - 2 q.x, so the nearest neighbours of q' have the greatest products. Vectors are dealt out by
a hash into parts of bounded size; each part is an M-tree of pages, whose entries keep their covering radius and
their distance from the parent's routing object. Queries come in blocks; a query searches a part best first, by the
least distance that a page's radius allows, and entries whose stored parent distance rules them out by the triangle
inequality cost no computation. Scores themselves are exact integers. The best of all parts are merged by Spark.

Defined results: vectors that are null, or hold a null or non-finite component, and rows without vec_id take no part;
of several rows with one vec_id the one with the least vector counts; a vector is compared with those of its own
length; equal vectors tie by vec_id; an empty table gives an empty one; scores beyond 64 bits raise an error; further
columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .session import stash

#: Vectors of a part, queries of a block, entries of a page.
PART, BLOCK, PAGE = 8192, 4096, 1024


class Node:
    """A page. Entries: routing objects with radius, distance from the page's own routing object, and child pages; or,
    in a leaf, vectors (radius 0)."""

    __slots__ = ("children", "parent", "points", "radius", "rows")

    def __init__(self, points, radius, parent, children, rows):
        self.points, self.radius, self.parent, self.children, self.rows = points, radius, parent, children, rows


class MTree:
    """An M-tree over integer vectors; `best` searches it."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, page: int = PAGE):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.page = ids[order], vectors[order], page
        exact = vectors.astype(object) if len(vectors) and np.abs(vectors.astype(float)).max(initial=0) > 2**24 else vectors
        norms = (exact * exact).sum(axis=1).astype(float) if len(vectors) else np.zeros(0)
        norms = norms[order]
        self.most = float(norms.max(initial=0.0))
        self.reach = float(np.abs(self.vectors.astype(float)).max(initial=0))
        self.places = np.concatenate([self.vectors.astype(float), np.sqrt(np.maximum(0.0, self.most - norms))[:, None]], axis=1)
        self.root = self._load(np.arange(len(ids)), None, 1)

    def _load(self, rows: np.ndarray, routing: np.ndarray | None, level: int) -> Node:
        if len(rows) <= self.page:
            points = self.places[rows]
            parent = np.zeros(len(rows)) if routing is None else np.linalg.norm(points - routing, axis=1)
            return Node(points, np.zeros(len(rows)), parent, None, rows)
        # Routing objects: members, evenly apart in the order of the rows; each row goes to the nearest.
        pivots = rows[np.linspace(0, len(rows) - 1, min(self.page, -(-2 * len(rows) // self.page))).astype(int)]
        at = self.places[pivots]
        square = (self.places[rows] ** 2).sum(axis=1)[:, None] - 2 * self.places[rows] @ at.T + (at**2).sum(axis=1)[None, :]
        owner = square.argmin(axis=1)
        if np.bincount(owner).max() == len(rows) or level > 40:  # equal vectors: pages by count
            owner = np.arange(len(rows)) // self.page
            pivots = rows[np.arange(0, len(rows), self.page)]
        children, points, radius, parent = [], [], [], []
        for i, pivot in enumerate(pivots.tolist()):
            mine = rows[owner == i]
            if len(mine):
                point = self.places[pivot]
                points.append(point)
                radius.append(float(np.linalg.norm(self.places[mine] - point, axis=1).max()))
                parent.append(0.0 if routing is None else float(np.linalg.norm(point - routing)))
                children.append(self._load(mine, point, level + 1))
        return Node(np.array(points), np.array(radius), np.array(parent), children, None)

    def _scores(self, node: Node, keep: np.ndarray, query: np.ndarray, at: np.ndarray, exact: bool) -> np.ndarray:
        """Inner products of the query with the vectors of a leaf; doubles hold them exactly while they are small."""
        if not exact:
            return np.array(products(self.vectors[node.rows[keep]], query), dtype=object)
        if 2 * len(keep) > len(node.rows):  # the page lies in one piece; the last coordinate meets the query's 0
            return (node.points @ at)[keep].astype(np.int64)
        return (node.points[keep] @ at).astype(np.int64)

    def best(self, query: np.ndarray, k: int, skip: int | None = None) -> list[tuple[int, int]]:
        """The k greatest (score, vec_id), ties to the smaller vec_id, without the vector of id skip."""
        size = float((query.astype(float) ** 2).sum())
        at = np.append(query.astype(float), 0.0)
        slack = 1e-9 * (1.0 + size + self.most)
        exact = self.reach * float(np.abs(at).max(initial=0)) * len(at) < 2**53
        found: list[tuple[int, int]] = []  # a heap of (score, -vec_id): the worst on top
        # Pages by the least distance possible; with it the distance of the query from the page's routing object.
        queue: list[tuple[float, int, float | None, Node]] = [(0.0, 0, None, self.root)]
        n = 0

        def reach() -> float:
            """The greatest distance at which a vector could still be among the best."""
            return np.inf if len(found) < k else np.sqrt(max(0.0, size + self.most - 2 * found[0][0]) + slack) + 1e-9

        while queue:
            low, _, up, node = heapq.heappop(queue)
            limit = reach()
            if low > limit:
                break
            keep = np.arange(len(node.points))
            if up is not None and limit < np.inf:
                keep = keep[np.abs(up - node.parent) - node.radius <= limit + slack]
            if not len(keep):
                continue
            if node.children is None:
                scores = self._scores(node, keep, query, at, exact)
                if len(found) == k:
                    good = np.flatnonzero(scores >= found[0][0])
                    keep, scores = keep[good], scores[good]
                for score, i in zip(scores.tolist(), self.ids[node.rows[keep]].tolist(), strict=True):
                    if i != skip and (len(found) < k or (score, -i) > found[0]):
                        (heapq.heappush if len(found) < k else heapq.heapreplace)(found, (score, -i))
            else:
                distance = np.linalg.norm(node.points[keep] - at, axis=1)
                least = np.maximum(0.0, distance - node.radius[keep] - slack)
                for j in np.flatnonzero(least <= limit).tolist():
                    n += 1
                    heapq.heappush(queue, (float(least[j]), n, float(distance[j]), node.children[int(keep[j])]))
        return [(score, -i) for score, i in sorted(found, reverse=True)]


def products(vectors: np.ndarray, query: np.ndarray) -> list[int]:
    """Inner products, exactly."""
    a, b = float(np.abs(vectors.astype(float)).max(initial=0)), float(np.abs(query.astype(float)).max(initial=0))
    if a * b * max(1, len(query)) < 2**53:
        return (vectors.astype(float) @ query.astype(float)).astype(np.int64).tolist()
    return (vectors.astype(object) @ query.astype(object)).tolist()


def _search(k: int, page: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors, tree = None, [], [], None
        for batch in batches:
            out: list[tuple] = []
            for length, part, block, query, vec_id, vector in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (length, part, block) != key:
                    key, ids, vectors, tree = (length, part, block), [], [], None
                if not query:
                    ids.append(vec_id)
                    vectors.append(vector)
                    continue
                if tree is None:
                    tree = MTree(np.array(ids, dtype=np.int64), np.array(vectors, dtype=np.int64).reshape(len(ids), length), page)
                    vectors = []
                out += [(vec_id, i, score) for score, i in tree.best(np.array(vector, dtype=np.int64), k, vec_id)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["query_id", "vec_id", "score"])

    return run


def top_k(embeddings: DataFrame, k: int = 20, every: int = 20, scale: int = 64, page: int = PAGE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each row whose vec_id is divisible by every."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(good)
    rows = stash(rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("length", F.size("v")))
    asked = F.col("vec_id") % every == 0
    counts = rows.groupBy("length").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"), F.greatest(F.lit(1), F.ceil(F.count_if(asked) / BLOCK)).cast("int").alias("blocks"))
    rows = rows.join(F.broadcast(counts), "length") if counts.count() <= 10_000 else rows.join(counts, "length")
    hashed = F.xxhash64("vec_id")
    members = rows.withColumns({"part": F.pmod(hashed, F.col("parts")), "block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "query": F.lit(False)})
    queries = rows.where(asked).withColumns({"part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "block": F.pmod(hashed, F.col("blocks")), "query": F.lit(True)})
    kind = ["length", F.col("part").cast("int").alias("part"), F.col("block").cast("int").alias("block"), "query", "vec_id", "v"]
    dealt = members.select(kind).union(queries.select(kind)).repartition("length", "part", "block").sortWithinPartitions("length", "part", "block", "query")
    found = dealt.mapInArrow(_search(k, page), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE_SQL = """
WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
