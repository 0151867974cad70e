"""Toxicity scores from subword-bag embeddings that are averaged into a linear softmax.

A word's vector is the mean of the vectors of its character n-grams, hashed into a fixed number of rows; a text's is
the mean of its words' and of a few neutral ones; a linear softmax gives its score. Embeddings and softmax are trained together, in numpy, so a
misspelling that was never seen shares most n-grams with words that were. As everything is linear up to the softmax, a
trained model comes down to one number for each row, and scoring adds those up.

Training takes a bounded sample of the labelled rows, `Model.most_toxic` and `Model.most_clean` of them at most and
`Model.most_bytes` of text, in the order of a hash of the text. A labelled text of more than 1 / `Model.longest_part` of its class's bytes (375 kB
toxic, 1.1 MB clean) is not trained on. Everything else covers all rows and whole texts.

Defined results: null text and text without letters or digits get the model's score of an empty text; null labels teach
nothing; where one class is missing every score is that class's share; rows are judged one by one; an empty table gives
an empty one; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .langid import remainder
from .textwords import U64, mix, slices, stream

SIZES = (3, 4, 5)


@dataclass(frozen=True)
class Model:
    rows_bits: int = 17
    dimensions: int = 4
    epochs: int = 60
    rate: float = 0.15
    scale: float = 40.0  # of a text's mean, so that few words among many can decide
    decay: float = 4e-5
    neutral_words: int = 12  # that every text is taken to have besides its own, so that short texts need strong words
    clean_weight: float = 2.0  # of all clean texts together against all toxic ones
    most_toxic: int = 1500
    most_clean: int = 4500
    most_bytes: int = 12_000_000
    longest_part: int = 8  # a text of more than one such part of its class's bytes is not trained on
    seed: int = 3


class Grams:
    """Rows of the character n-grams of texts. A word is a run of letters and digits; n-grams may include the edge on
    either side of it, but nothing beyond."""

    def __init__(self, bits: int):
        self.shift = U64(64 - bits)
        self.kind = np.full(0x110000, -1, dtype=np.int8)  # by code point: 1 for letters and digits
        self.factors = stream(91, max(SIZES)) | U64(1)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, word) of each n-gram, and the text of each word; words are numbered from 0."""
        lowered = [" " + t.lower() for t in texts] + [" "]
        points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kind = self.kind[points]
        if (kind < 0).any():
            for p in np.unique(points[kind < 0]).tolist():
                self.kind[p] = chr(p).isalnum()
            kind = self.kind[points]
        inside = kind > 0
        keep = inside.copy()
        keep[1:] |= inside[:-1]
        keep[0] = True
        points, inside = np.where(inside, points, 0)[keep], inside[keep]
        owner = np.repeat(np.arange(len(lowered)), [len(t) for t in lowered])[keep]
        word = np.cumsum(inside & ~np.append(False, inside[:-1])) - 1
        begins = np.flatnonzero(inside & ~np.append(False, inside[:-1]))
        code = mix(points.astype(U64) + U64(17))
        rows, words = [], []
        with np.errstate(over="ignore"):
            for n in SIZES:
                m = len(code) - n + 1
                if m <= 0:
                    continue
                h = code[:m] * self.factors[0]
                whole = np.ones(m, dtype=bool)
                for j in range(1, n):
                    h = h + code[j : j + m] * self.factors[j]
                    if j < n - 1:
                        whole &= inside[j : j + m]
                at = np.flatnonzero(whole)
                rows.append((mix(h[at] + U64(n)) >> self.shift).astype(np.int32))
                words.append(word[at + 1].astype(np.int32))
        if not rows or not len(begins):
            none = np.zeros(0, dtype=np.int32)
            return none, none, owner[begins]
        return np.concatenate(rows), np.concatenate(words), owner[begins]


def train(texts: list[str], labels: np.ndarray, model: Model) -> tuple[np.ndarray, float]:
    """One number for each n-gram row and the intercept: the log-odds of a text are the intercept plus the mean, over its
    words and the neutral ones, of the mean of their n-grams' numbers."""
    share = float(labels.mean()) if len(labels) else 0.0
    if not len(labels) or share in (0.0, 1.0):
        return np.zeros(1 << model.rows_bits, dtype=np.float32), float(np.clip(np.log(max(share, 1e-6) / max(1 - share, 1e-6)), -13, 13))
    cutter = Grams(model.rows_bits)
    # The texts' different words once, and each text as counts of them.
    pieces, index, text_of, word_of = [], {}, [], []
    for i, text in enumerate(texts):
        for w in "".join(c if c.isalnum() else " " for c in text.lower()).split():
            text_of.append(i)
            word_of.append(index.setdefault(w, len(index)))
    rows, words, _ = cutter.of(list(index))
    order = np.argsort(words, kind="stable")
    rows, words = rows[order], words[order]
    n_words, n_texts, size = len(index), len(texts), 1 << model.rows_bits
    per_word = np.maximum(np.bincount(words, minlength=n_words), 1).astype(np.float32)
    used, rows = np.unique(rows, return_inverse=True)
    pair, count = np.unique(np.array(text_of, dtype=np.int64) * n_words + np.array(word_of, dtype=np.int64), return_counts=True)
    t, w = pair // n_words, pair % n_words
    weight = (count / (np.bincount(t, weights=count, minlength=n_texts) + model.neutral_words)[t] * model.scale).astype(np.float32)
    rng = np.random.default_rng(model.seed)
    e = (rng.normal(size=(len(used), model.dimensions)) * 0.1).astype(np.float32)
    u = (rng.normal(size=(model.dimensions, 2)) * 0.1).astype(np.float32)
    b = np.zeros(2, dtype=np.float32)
    target = np.eye(2, dtype=np.float32)[labels.astype(int)]
    importance = np.where(labels > 0, 1 / share, model.clean_weight / (1 - share)).astype(np.float32)[:, None] / (1 + model.clean_weight) / n_texts
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (e, u, b)]

    def mean_of(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(at, weights=values[:, j], minlength=n) for j in range(values.shape[1])], axis=1).astype(np.float32)

    for epoch in range(1, model.epochs + 1):
        word_vectors = mean_of(e[rows], words, n_words) / per_word[:, None]
        text_vectors = mean_of(word_vectors[w] * weight[:, None], t, n_texts)
        logits = text_vectors @ u + b
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        error = (p / p.sum(axis=1, keepdims=True) - target) * importance
        text_grad = error @ u.T
        word_grad = mean_of(text_grad[t] * weight[:, None], w, n_words) / per_word[:, None]
        grads = (mean_of(word_grad[words], rows, len(used)) + model.decay * e, text_vectors.T @ error + model.decay * u, error.sum(axis=0))
        for p, g, m in zip((e, u, b), grads, moments, strict=True):
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.01 * (g * g - m[1])
            p -= model.rate * (m[0] / (1 - 0.9**epoch)) / (np.sqrt(m[1] / (1 - 0.99**epoch)) + 1e-8)
    numbers = np.zeros(size, dtype=np.float32)
    numbers[used] = e @ (u[:, 1] - u[:, 0]) * model.scale
    return numbers, float(b[1] - b[0])


def odds(texts: list[str], cutter: Grams, numbers: np.ndarray, intercept: float, model: Model) -> np.ndarray:
    rows, words, owner = cutter.of(texts)
    per_word = np.bincount(words, weights=numbers[rows], minlength=len(owner)) / np.maximum(np.bincount(words, minlength=len(owner)), 1)
    return intercept + np.bincount(owner, weights=per_word, minlength=len(texts))[: len(texts)] / (np.bincount(owner, minlength=len(texts))[: len(texts)] + model.neutral_words)


def sampled(docs: DataFrame, labels: DataFrame, model: Model) -> tuple[list[str], np.ndarray]:
    """The bounded sample of texts and labels: the first of each class by a hash of the text, as far as the bytes go.

    Hashes and sizes are joined with the labels; texts are read for the chosen rows only, which are few by the model's
    bounds and so can be broadcast.
    """
    docs = docs.where("text IS NOT NULL").select("doc_id", "text", F.xxhash64(F.lit(model.seed), "text").alias("h"))
    facts = docs.select("doc_id", "h", F.octet_length("text").alias("size")).join(labels.where("toxic IN (0, 1)").select("doc_id", "toxic"), "doc_id")
    chosen = []
    for toxic, most in ((1, model.most_toxic), (0, model.most_clean)):
        budget = model.most_bytes * most // (model.most_toxic + model.most_clean)
        first = facts.where((F.col("toxic") == toxic) & (F.col("size") <= budget // model.longest_part)).orderBy("h", "doc_id").limit(most).collect()
        upto = int(np.searchsorted(np.cumsum([r["size"] for r in first]), budget, side="right"))
        chosen += [(r["doc_id"], r["h"], toxic) for r in first[:upto]]
    if not chosen:
        return [], np.zeros(0, dtype=np.int64)
    few = F.broadcast(docs.sparkSession.createDataFrame(chosen, "doc_id long, h long, toxic int").dropDuplicates())
    rows = docs.withColumn("doc_id", F.col("doc_id").cast("long")).join(few, ["doc_id", "h"]).groupBy("h", "doc_id", "toxic").agg(F.first("text").alias("text"))
    found = sorted(rows.collect(), key=lambda r: (-r["toxic"], r["h"], r["doc_id"]))
    return [r["text"] for r in found], np.array([r["toxic"] for r in found])


def score(docs: DataFrame, numbers: np.ndarray, intercept: float, model: Model) -> DataFrame:
    """docs' columns but text, with score and predicted."""
    others = [c for c in docs.columns if c != "text"]
    docs = docs.select(*others, "text")
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, table = Grams(model.rows_bits), shared.value
        for batch in slices(batches, limit=1 << 19):
            found = 1 / (1 + np.exp(-np.clip(odds([t or "" for t in batch.column(len(others)).to_pylist()], cutter, table, intercept, model), -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found), pa.array((found >= 0.5).astype(np.int32))], [*others, "score", "predicted"])

    schema = docs.select(others).schema.add("score", "double").add("predicted", IntegerType())
    return docs.mapInArrow(run, schema)


def digest(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of rows that are held out are never read."""
    model = model or Model()
    known = labels.select("doc_id", "toxic").where(remainder("doc_id", 5) != 0)
    numbers, intercept = train(*sampled(docs.select("doc_id", "text"), known, model), model)
    return score(docs.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "text"), numbers, intercept, model)
