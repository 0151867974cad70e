"""Compression of vectors to four bytes: product codes with integer codebooks, assigned exactly.

Components are whole numbers. For each part of a vector the products with all entries of the codebook come from one
float32 matrix product; how far it may be off follows from the rounding of each operand and each sum (the usual bound
for inner products, whatever the order of summation), so each entry has an interval that holds its true distance. Only
entries whose interval overlaps the best one's are evaluated again, in int64, and ties go to the lowest index. The
result is that of exact arithmetic.

Each round is a job over the stored vectors. A task sums its vectors by part and entry, these sums are added up in a
shuffle of at most 1024 rows a task, and the driver gets 1024 rows, whatever the input. Codebooks (256 vectors) travel
with the tasks.

Defined results: rows whose vector is null or holds null, NaN or infinite components are dropped; so are rows whose
vector doesn't have the most frequent length (of equally frequent ones the longest). A length that four doesn't divide is
filled up with zeros at the end. Components beyond +-2^27 are clamped to that, so distances stay within int64; sums of
errors beyond 2^63 - 1 are given as that. With fewer than 256 vectors the codebooks are as long as there are vectors. A
null vec_id comes after all others; repeated rows are rows of their own; empty vectors have code 00000000 and error 0; an
empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import join_unique, release, small_batches, stash

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LIMIT = 1 << 27
#: Rows whose products with a codebook are held at a time.
STEP = 1024
RESULT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def overlapping(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, entries) whose interval of |entry|^2 / 2 - <row, entry> overlaps that of the row's best, by row and entry.

    With unit roundoff u, a float32 inner product of m terms of rounded operands is off by at most
    (m + 2) u / (1 - (m + 2) u) times the product of the norms.
    """
    terms = (x.shape[1] + 2) * 2.0**-24
    product = (x.astype(np.float32) @ book.astype(np.float32).T).astype(np.float64)
    wide_x, wide_book = x.astype(np.float64), book.astype(np.float64)
    squares = (wide_book**2).sum(axis=1)
    reach = np.sqrt((wide_x**2).sum(axis=1))[:, None] * np.sqrt(squares)[None, :]
    middle = squares / 2 - product
    # The last terms are for the float64 arithmetic, here and in the norms.
    off = reach * (terms / (1 - terms) * (1 + 1e-9)) + (squares + np.abs(product)) * 2.0**-45 + 1e-300
    return np.nonzero(middle - off <= (middle + off).min(axis=1)[:, None])


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the entry with the least squared distance to each row, the lowest of equals, and that distance."""
    codes, least = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
    for at in range(0, len(x), STEP):
        part = x[at : at + STEP]
        rows, entries = overlapping(part, book)
        distances = ((part[rows] - book[entries]) ** 2).sum(axis=1)
        first = np.searchsorted(rows, np.arange(len(part)))
        best = np.minimum.reduceat(distances, first)
        hits = np.flatnonzero(distances == best[rows])
        _, lowest = np.unique(rows[hits], return_index=True)
        codes[at : at + STEP], least[at : at + STEP] = entries[hits[lowest]], best
    return codes, least


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, cells: the vectors of the most frequent length as whole numbers, filled up to a multiple of four."""
    finite = embeddings.where(F.coalesce(F.forall("embedding", lambda x: F.abs(x) < float("inf")), F.lit(False)))
    lengths = finite.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths["d"] if lengths else 0
    floored = F.transform("embedding", lambda x: F.floor(F.greatest(F.lit(-1.0 * LIMIT), F.least(F.lit(1.0 * LIMIT), SCALE * x.cast("double")))).cast("int"))
    cells = F.concat(floored, F.array_repeat(F.lit(0), -d % PARTS)) if d % PARTS else floored
    return finite.where(F.size("embedding") == d).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), cells.alias("cells"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), d)


def cut(x: np.ndarray) -> list[np.ndarray]:
    return np.split(x, PARTS, axis=1)


def next_books(vectors: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Each entry replaced by the floored mean of the parts nearest to it; an entry without any stays."""
    k, m = books[0].shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((PARTS, k), dtype=np.int64), np.zeros((PARTS, k, m), dtype=np.int64)
        for batch in batches:
            for p, x in enumerate(cut(matrix(batch.column(0), PARTS * m))):
                codes, _ = nearest(x, books[p])
                order = np.argsort(codes, kind="stable")
                found, first = np.unique(codes[order], return_index=True)
                if len(found):
                    count[p, found] += np.diff([*first, len(codes)])
                    total[p, found] += np.add.reduceat(x[order], first, axis=0)
        part, entry = np.nonzero(count)
        cells = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * m, pa.int32()), pa.array(total[part, entry].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]), cells], ["part", "entry", "n", "total"])

    found = vectors.select("cells").mapInArrow(sums, "part int, entry int, n long, total array<long>")
    summed = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(m)))
    out = [b.copy() for b in books]
    for r in summed.collect():  # PARTS * ENTRIES rows at most
        out[r["part"]][r["entry"]] = np.array([r[f"t{i}"] for i in range(m)], dtype=np.int64) // r["n"]
    return out


def fit(vectors: DataFrame) -> list[np.ndarray]:
    """The codebooks after all rounds, one for each part."""
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "cells").select("cells").limit(ENTRIES).collect()
    books = cut(np.array([r["cells"] for r in first], dtype=np.int64).reshape(len(first), -1))
    for _ in range(ROUNDS if books[0].shape[1] else 0):
        books = next_books(vectors, books)
    return books


def encode(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code, error."""
    d = PARTS * books[0].shape[1]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [nearest(x, books[p]) for p, x in enumerate(cut(matrix(batch.column(2), d)))]
            digits = np.stack([c for c, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            codes = pa.array([digits[i : i + 2 * PARTS] for i in range(0, len(digits), 2 * PARTS)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), codes, pa.array(sum(e for _, e in found))], ["vec_id", "label", "code", "error"])

    return vectors.mapInArrow(coded, "vec_id long, label string, code string, error long")


def digest_of(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: a row for each vector that takes part."""
    spark = embeddings.sparkSession
    small_batches(spark)
    vectors = stash(whole_vectors(embeddings))
    if vectors.isEmpty():
        return spark.createDataFrame([], RESULT)
    books = fit(vectors)
    key = F.struct(F.col("label").isNull().alias("none"), F.coalesce("label", F.lit("")).alias("name"))
    coded = stash(encode(vectors, books).withColumn("of", key))
    release(vectors)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
    totals = stash(coded.groupBy("of").agg(total.alias("label_error"), F.count("*").alias("n")))
    return join_unique(coded, totals, "of", "n").select("vec_id", "code", "error", "label_error", F.lit(digest_of(books)).alias("codebooks_sha256"))


def _round_sql(i: int) -> str:
    """The codebook after round i from that before."""
    return f"""near{i} AS MATERIALIZED (SELECT r, p, (min(256 * d + e) % 256)::BIGINT AS e FROM ({_distances(f"book{i - 1}")}) GROUP BY r, p),
mean{i} AS (SELECT p, e, list(floor(s / n)::BIGINT ORDER BY i) AS c FROM (SELECT p, e, i, sum(x[i])::DOUBLE AS s, count(*) AS n
  FROM near{i} JOIN parts USING (r, p), (SELECT unnest(range(1, (SELECT max(len(x)) FROM parts) + 1)) AS i) GROUP BY p, e, i) GROUP BY p, e),
book{i} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{i - 1} b LEFT JOIN mean{i} m ON b.p = m.p AND b.e = m.e),
"""


def _distances(book: str) -> str:
    dot = "list_dot_product({0}::DOUBLE[], {1}::DOUBLE[])::BIGINT"
    return f"SELECT r, parts.p, e, {dot.format('x', 'x')} - 2 * {dot.format('x', 'c')} + {dot.format('c', 'c')} AS d FROM parts JOIN {book} book ON parts.p = book.p"


#: For vectors of one length that four divides, with components small enough for exact products in double.
ORACLE_SQL = (
    """
WITH whole AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS x FROM whole, (SELECT unnest(range(0, 4)) AS p)),
book0 AS MATERIALIZED (SELECT p, e, x AS c FROM parts JOIN (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM whole) USING (r) WHERE e < 256),
"""
    + "".join(_round_sql(i) for i in range(1, ROUNDS + 1))
    + f"""final AS (SELECT r, string_agg(format('{{:02x}}', m % 256), '' ORDER BY p) AS code, sum(m // 256)::BIGINT AS error
  FROM (SELECT r, p, min(256 * d + e)::BIGINT AS m FROM ({_distances(f"book{ROUNDS}")}) GROUP BY r, p) GROUP BY r),
listed AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM whole JOIN final USING (r), listed
"""
)
