"""Quality classifier: nearest labelled neighbours in a latent-semantic space vote."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.langid import grams, held_out
from fathomline.llm.shared import cut, small_batches, tidy

#: The space is fitted on at most so many labelled documents, which are the neighbours.
LABELLED = 4_096
#: Dimensions of the space, neighbours that vote (half the root of their number, if that is fewer), and steps of a vector's components:
#: products of such vectors are exact in 32-bit floats.
RANK, NEIGHBOURS, STEPS = 48, 16, 2_000
#: Score from which a document counts as good.
GOOD = 0.3
#: Terms: runs of so many bytes and shapes of words, hashed to so many bits; pairs of adjacent words, equal or not.
GRAMS, GRAM_BITS, SHAPE_BITS = (1, 2, 3), 13, 9
TERMS = (1 << GRAM_BITS) + (1 << SHAPE_BITS) + 2
#: Bytes that are read at once.
PIECE = 1 << 18
#: Shapes: letters, digits and blanks by kind, other characters as they are; runs count once.
SHAPE = bytes(32 if b <= 32 else 97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))


def counts(text: bytes) -> np.ndarray:
    """How often each term occurs in the whole text; read piece by piece, cut at blanks, which changes no count."""
    found = np.zeros(TERMS)
    shapes: Counter = Counter()
    start, tail, last, same, words = 0, b" ", b"", 0, 0
    while start < len(text):
        end = len(text)
        if end - start > PIECE:
            cuts = [c for c in (text.find(b, start + PIECE) for b in (b" ", b"\n")) if c >= 0]
            end = min(cuts) + 1 if cuts else end
        piece, start = text[start:end], end
        whole = tail + piece + (b" " if end == len(text) else b"")
        data = np.frombuffer(whole, np.uint8)
        for n in GRAMS:
            for i in range(0, len(data), PIECE):  # a piece without blanks may be long
                part = data[max(i - n + 1, len(tail) - n + 1, 0) : i + PIECE]
                found[: 1 << GRAM_BITS] += np.bincount(grams(part, n, GRAM_BITS), minlength=1 << GRAM_BITS)
        tail = whole[-(max(GRAMS) - 1) :]
        kinds = np.frombuffer(piece.translate(SHAPE), np.uint8)
        kinds = kinds[np.concatenate([[True], kinds[1:] != kinds[:-1]])]
        shapes.update(kinds.tobytes().split())
        parts = piece.split()
        same += sum(map(eq, parts[1:], parts)) + (bool(parts) and bool(last) and parts[0] == last)
        words += len(parts)
        last = parts[-1] if parts else last
    for s, n in shapes.items():
        found[(1 << GRAM_BITS) + crc32(s) % (1 << SHAPE_BITS)] += n
    found[-2:] = same, max(words - 1 - same, 0)
    return found


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x**2).sum(-1, keepdims=True)), 1e-12)


def weighed(found: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Term weights of counts: the three families of terms weigh the same, each with length 1."""
    a, b = 1 << GRAM_BITS, TERMS - 2
    return np.concatenate([_unit(np.log1p(found[..., :a]) * rarity), _unit(np.sqrt(found[..., a:b])), _unit(np.sqrt(found[..., b:]))], axis=-1).astype(np.float32)


@dataclass
class Model:
    """``rarity`` weighs byte runs, ``axes`` turns term weights into the latent space, ``vectors`` and ``labels`` are the neighbours there."""

    rarity: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def place(self, text: bytes) -> np.ndarray:
        """The vector of a text, of length 1 in whole steps; of zeros without words."""
        return np.round(_unit(weighed(counts(text), self.rarity) @ self.axes) * STEPS).astype(np.float32) if text.strip() else np.zeros(self.axes.shape[1], np.float32)

    def vote(self, vectors: np.ndarray) -> np.ndarray:
        """The share of label 1 among the nearest neighbours of each vector, weighed by cosine; ties go to the earlier neighbour.

        Products of all vectors with all neighbours are taken block by block and are whole numbers. Without a neighbour of positive cosine, the share of
        label 1 among all.
        """
        n = len(self.labels)
        k = max(1, min(NEIGHBOURS, round(n**0.5 / 2)))
        scores = np.empty(len(vectors))
        for i in range(0, len(vectors), 256):
            like = (vectors[i : i + 256] @ self.vectors.T).astype(np.int64)
            nearest = np.argpartition(like * n + np.arange(n - 1, -1, -1), n - k, axis=1)[:, n - k :]
            weight = np.maximum(np.take_along_axis(like, nearest, axis=1), 0)
            good = (weight * self.labels[nearest]).sum(1)
            all_ = weight.sum(1)
            scores[i : i + 256] = np.where(all_ > 0, good / np.maximum(all_, 1), self.labels.mean())
        return scores


def fit(found: np.ndarray, labels: np.ndarray, seed: int = 5) -> Model:
    """The space of latent semantics of the labelled documents' counts: singular vectors of their term weights, by subspace iteration.

    ``found`` becomes the weights in place: it is the one large array that the driver holds.
    """
    a, x = 1 << GRAM_BITS, found
    rarity = np.log((1 + len(found)) / (1 + np.count_nonzero(found[:, :a], axis=0))).astype(np.float32)
    for i in range(0, len(found), 256):
        x[i : i + 256] = weighed(found[i : i + 256], rarity)
    basis = np.random.default_rng(seed).normal(size=(TERMS, min(RANK + 8, len(x)))).astype(np.float32)
    for _ in range(5):
        basis, _ = np.linalg.qr(x.T @ np.linalg.qr(x @ basis)[0])
    _, s, axes = np.linalg.svd(x @ basis, full_matrices=False)
    rank = max(1, min(RANK, int((s > 1e-4 * s[0]).sum())))
    axes = (basis @ axes.T[:, :rank] / np.sqrt(s[:rank])).astype(np.float32)
    return Model(rarity, axes, np.round(_unit(x @ axes) * STEPS).astype(np.float32), np.asarray(labels, np.int64))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model | None:
    """Fits on the :data:`LABELLED` labelled documents of least hash outside :func:`~fathomline.llm.langid.held_out`; None without any.

    Their terms are counted whole, where the documents are; counts and labels go to the driver, a row of at most :data:`TERMS` numbers each.
    A document with both labels, or texts that share a key, give a neighbour each; equal rows give one. Labels other than 0 and 1 are ignored.
    """
    texts = docs.filter(~held_out(key)).select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    marks = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1)).distinct()
    order = F.xxhash64(F.lit(13), "k", "h")
    chosen = texts.select("k", "h").distinct().join(marks, "k").withColumn("turn", order).orderBy("turn", "k", "h", "y").limit(LABELLED)
    chosen = cut(chosen, "quality-labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tidy(batches):
            found = [counts(t) for t in b.column("t").to_pylist()]
            at = [np.flatnonzero(f) for f in found]
            parts = [pa.array([i.astype(np.int32).tobytes() for i in at], pa.binary()), pa.array([f[i].astype(np.float32).tobytes() for f, i in zip(found, at, strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("y"), b.column("turn"), *parts], ["y", "turn", "terms", "n"])

    # LABELLED bounds the rows of the side that is broadcast.
    rows = texts.join(F.broadcast(chosen), ["k", "h"]).groupBy("k", "h", "y", "turn").agg(F.first("t").cast("binary").alias("t"))
    sample = sorted(rows.select("y", "turn", "t").mapInArrow(count, "y int, turn long, terms binary, n binary").collect(), key=lambda r: (r["turn"], r["y"], bytes(r["n"])))
    if not sample:
        return None
    found = np.zeros((len(sample), TERMS), np.float32)
    for f, r in zip(found, sample, strict=True):
        f[np.frombuffer(r["terms"], np.int32)] = np.frombuffer(r["n"], np.float32)
    truth = np.array([r["y"] for r in sample])
    del sample
    return fit(found, truth)


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Adds ``score``, likeliness of label 1 by the nearest neighbours' vote, and ``predicted`` (1 from :data:`GOOD` on).

    Reads whole texts and nothing else; equal texts get equal scores. Texts that are NULL or without words get the share of label 1 among the
    neighbours, and every text 0.5 without a model. Columns of ``docs`` with those names are replaced.
    """
    small_batches(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("score", "predicted")]
    if model is None:
        return docs.select(*own, F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))

    @F.pandas_udf("double")
    def vote(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in tidy(batches):
            yield pd.Series(model.vote(np.array([model.place(t) for t in texts], np.float32).reshape(len(texts), -1)))

    score = vote(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    return docs.withColumn("_vote", score).select(*own, F.col("_vote").alias("score"), (F.col("_vote") >= GOOD).cast("int").alias("predicted"))


def rate(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Trains on ``labels`` of ``docs`` and returns ``key``, ``held_out``, ``score`` and ``predicted`` for each row of ``docs``.

    See :func:`train` and :func:`predict`. Repeated rows are rows of their own, a NULL key counts as held out, an empty table gives no rows.
    """
    rows = docs.select(F.col(key), held_out(key).alias("held_out"), F.col(text).alias("_text"))
    return predict(rows, train(docs, labels, key, text, label), "_text").select(key, "held_out", "score", "predicted")
