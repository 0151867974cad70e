"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, from a seed and the letter alone. A trigram's vector binds (multiplies)
those of its letters, permuted (rotated) by their place; a text's vector bundles (adds) those of its trigrams; a
language's prototype bundles the texts that are known to be in it. A text gets the language whose prototype has the
greatest cosine with it. All labelled rows that are given take part in the prototypes, which are added up within tasks
and then by Spark; only the prototypes, one vector for each language, come to the driver.

Letters are what Unicode calls letters, in lower case; runs of anything else are one space.

Defined results: text that is null or has no letter, or any text where nothing could be learned, is `und` with score 0;
ties go to the language that sorts first; null languages teach nothing; rows are judged one by one; an empty table
gives an empty one; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textwords import U64, mix, slices

#: More languages than this are taken for a mistake in the labels rather than brought to the driver.
MOST_LANGUAGES = 10_000
#: Letters up to which trigrams are counted by a table rather than by sorting.
TABLE_LETTERS = 160
#: Texts whose vectors are held at a time.
TEXTS = 1024


@dataclass(frozen=True)
class Space:
    dimensions: int = 1024
    seed: int = 5


class Profiler:
    """Vectors of texts. Letters are numbered as they are met; the numbers never leave the object."""

    def __init__(self, space: Space):
        self.space = space
        self.symbol = np.full(0x110000, -1, dtype=np.int32)  # by code point; 0 is the space
        self.points: list[int] = []
        self.letters = np.zeros((0, space.dimensions), dtype=np.int8)

    def _meet(self, points: np.ndarray) -> None:
        fresh = []
        for p in points.tolist():
            if chr(p).isalpha() or not self.points:
                self.symbol[p] = len(self.points)
                self.points.append(p)
                fresh.append(p)
            else:
                self.symbol[p] = 0
        if fresh:
            words = self.space.dimensions // 64
            with np.errstate(over="ignore"):
                bits = mix(mix(np.array(fresh, dtype=U64)[:, None] + U64(self.space.seed << 32)) + np.arange(words, dtype=U64))
            signs = np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) * 2 - 1
            self.letters = np.concatenate([self.letters, signs])

    def trigrams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, second, third) symbols of the different trigrams; for each occurrence its text and its trigram."""
        if not self.points:
            self._meet(np.array([32]))
        lowered = [" " + t.lower() for t in texts] + [" "]
        points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        s = self.symbol[points]
        if (s < 0).any():
            self._meet(np.unique(points[s < 0]))
            s = self.symbol[points]
        owner = np.repeat(np.arange(len(lowered)), [len(t) for t in lowered])
        keep = np.ones(len(s), dtype=bool)
        keep[1:] = (s[1:] > 0) | (s[:-1] > 0)
        s, owner = s[keep].astype(np.int64), owner[keep]
        m = len(self.points)
        whole = owner[1:-1]  # a trigram belongs to the text of its middle; the space between two texts serves both
        ids = (s[:-2] * m + s[1:-1]) * m + s[2:]
        whole, ids = whole[s[1:-1] > 0], ids[s[1:-1] > 0]
        if m <= TABLE_LETTERS:
            seen = np.zeros(m**3, dtype=np.int32)
            seen[ids] = 1
            different = np.flatnonzero(seen)
            seen[different] = np.arange(len(different))
            place = seen[ids]
        else:
            different, place = np.unique(ids, return_inverse=True)
        return np.stack([different // (m * m), different // m % m, different % m]), whole, place

    def bundle(self, texts: list[str], groups: np.ndarray | None = None) -> np.ndarray:
        """The sum of trigram vectors of each text, or of each group of texts (groups: a number for each text)."""
        symbols, owner, place = self.trigrams(texts)
        n = len(texts) if groups is None else int(groups.max(initial=-1)) + 1
        if groups is not None:
            owner = groups[owner]
        d = symbols.shape[1]
        out = np.zeros((n, self.space.dimensions), dtype=np.float32)
        rotated = [np.roll(self.letters, 2 - j, axis=1) for j in range(3)]
        # Trigrams are worked on 2048 at a time, so the table of texts and trigrams has as many columns at most.
        order = np.argsort(place, kind="stable")
        owner, place = owner[order], place[order]
        for a in range(0, d, 2048):
            i, j = np.searchsorted(place, [a, a + 2048])
            width = min(2048, d - a)
            counts = np.bincount(owner[i:j] * width + place[i:j] - a, minlength=n * width).reshape(n, width).astype(np.float32)
            first, second, third = (rotated[k][symbols[k, a : a + 2048]] for k in range(3))
            out += counts @ (first * second * third).astype(np.float32)
        return out


def _by_language(space: Space):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler, sums = Profiler(space), {}
        for batch in slices(batches, rows=TEXTS):
            names = batch.column(1).to_pylist()
            langs = sorted(set(names))
            number = {x: i for i, x in enumerate(langs)}
            found = profiler.bundle(batch.column(0).to_pylist(), np.array([number[x] for x in names]))
            for lang, vector in zip(langs, found, strict=True):
                sums[lang] = sums.get(lang, 0) + vector.astype(np.int64)
        yield _sums(sums)

    return run


def _sums(sums: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["lang", "vector"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict = {}
    for batch in batches:
        for lang, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[lang] = sums.get(lang, 0) + np.frombuffer(vector, dtype=np.int64)
    yield _sums(sums)


def prototypes(rows: DataFrame, space: Space | None = None) -> dict[str, np.ndarray]:
    """A vector for each language of rows (text, lang), whole numbers added up exactly, whatever the order."""
    sums = rows.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInArrow(_by_language(space or Space()), "lang string, vector binary")
    # Each task sends a vector for each of its languages; they are added in up to 64 tasks, then by the driver.
    sums = sums.repartition(64).mapInArrow(_added, "lang string, vector binary")
    out: dict[str, np.ndarray] = {}
    for lang, vector in sums.toLocalIterator():
        out[lang] = out.get(lang, 0) + np.frombuffer(bytes(vector), dtype=np.int64)
        if len(out) > MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return dict(sorted((k, v) for k, v in out.items() if np.any(v)))


def identify(docs: DataFrame, known: dict[str, np.ndarray], space: Space | None = None) -> DataFrame:
    """docs' columns but text, with lang_pred and score (the cosine, at least 0)."""
    space = space or Space()
    names = list(known)
    matrix = np.array([v / np.linalg.norm(v.astype(float)) for v in known.values()], dtype=np.float32).reshape(len(names), space.dimensions)
    others = [c for c in docs.columns if c != "text"]
    docs = docs.select(*others, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler = Profiler(space)
        for batch in slices(batches, rows=TEXTS):
            vectors = profiler.bundle([t or "" for t in batch.column(len(others)).to_pylist()])
            norms = np.linalg.norm(vectors, axis=1)
            lang, score = ["und"] * len(vectors), np.zeros(len(vectors))
            if names:
                cosines = vectors @ matrix.T / np.maximum(norms, 1e-9)[:, None]
                best = cosines.argmax(axis=1)
                lang = [names[b] if n > 0 else "und" for b, n in zip(best.tolist(), norms.tolist(), strict=True)]
                score = np.where(norms > 0, np.clip(cosines.max(axis=1), 0, 1), 0).astype(float)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang), pa.array(score)], [*others, "lang_pred", "score"])

    schema = docs.select(others).schema.add("lang_pred", "string").add("score", "double")
    return docs.mapInArrow(run, schema)


def remainder(column: str, divisor: int):
    """crc32 of an id as text modulo divisor; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def digest(docs: DataFrame, space: Space | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score; rows that are held out teach nothing."""
    known = prototypes(docs.where(remainder("doc_id", 3) != 1).select("text", "lang"), space)
    return identify(docs.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "text"), known, space)
