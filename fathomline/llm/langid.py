"""Language identification: averaged hashed subword embeddings with a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.llm.shared import small_batches, tidy

#: Label of texts without any letter.
UNDETERMINED = "und"
#: Subwords are runs of so many bytes.
GRAMS = (2, 3, 4)
#: The model is fitted on at most so many labelled rows per language, on a window of so many code points of each.
TRAIN_ROWS, TRAIN_CHARS = 1_500, 4_000
#: Values of the hash that orders them.
SPREAD = 1 << 40
#: Share of validation windows that a correct model may reject.
REJECTED = 0.001


def grams(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The hash of the ``n`` bytes that start at each place."""
    size = len(data) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64)
    h = np.full(size, n, np.uint32)
    for i in range(n):
        h *= np.uint32(16777619)
        h ^= data[i : i + size]
    h *= np.uint32(2654435761)
    h >>= np.uint32(32 - bits)
    return h.astype(np.int64)


@dataclass
class Model:
    """``table`` has the logits of each subword: its embedding times the softmax weights. ``threshold``: see :func:`fit`."""

    labels: list[str]
    table: np.ndarray
    bias: np.ndarray
    bits: int
    temperature: float
    threshold: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """Calibrated probabilities of each label for each whole text: logits are averaged over its subwords."""
        logits = np.tile(self.bias, (len(texts), 1)).astype(float)
        i = 0
        while i < len(texts):  # a few texts at once, and at least one
            j, size, encoded = i, 0, []
            while j < len(texts) and (j == i or size + len(texts[j]) <= 1 << 18):
                encoded.append(f" {texts[j]} ".lower().encode())
                size += len(encoded[-1])
                j += 1
            data = np.frombuffer(b"".join(encoded), np.uint8)
            ends = np.cumsum([len(e) for e in encoded])
            total, count = np.zeros((j - i, len(self.labels))), np.zeros(j - i)
            for n in GRAMS:
                for start in range(0, len(data), 1 << 18):  # a very long text in slices, which overlap by n - 1 bytes
                    part = data[start : start + (1 << 18) + n - 1]
                    of = np.searchsorted(ends, np.arange(start, start + max(0, len(part) - n + 1)), side="right")
                    # Runs over the end of a text belong to none.
                    own = np.arange(start + n, start + len(part) + 1) <= ends[np.minimum(of, j - i - 1)]
                    keys, of = grams(part, n, self.bits)[own], of[own]
                    for c in range(len(self.labels)):
                        total[:, c] += np.bincount(of, self.table[:, c][keys], j - i)
                    count += np.bincount(of, minlength=j - i)
            logits[i:j] += total / np.maximum(count, 1)[:, None]
            i = j
        z = logits / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def _windows(texts: list[str], rng: np.random.Generator) -> list[str]:
    """A run of each text, of a random length: short texts are as common in training as long ones."""
    out = []
    for t in texts:
        size = int(min(len(t), np.exp(rng.uniform(np.log(8), np.log(TRAIN_CHARS)))))
        start = int(rng.integers(0, len(t) - size + 1))
        out.append(t[start : start + size])
    return out


def fit(texts: list[str], labels: list[str], bits: int = 16, width: int = 8, epochs: int = 4, rate: float = 8.0, seed: int = 3) -> Model | None:
    """Fits embeddings and softmax weights by stochastic gradient descent, then calibrates on a tenth kept apart.

    Each step takes one text: its subwords' embeddings are averaged, and the gradient of the cross entropy goes to weights
    and to those embeddings. The temperature is what gives the least cross entropy on the part kept apart. The rejection
    threshold is the score that all but :data:`REJECTED` of its correctly labelled windows reach.
    """
    names = sorted(set(labels))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    y = np.array([names.index(x) for x in labels])
    held = rng.random(len(y)) < 0.1
    emb = rng.normal(0, 0.1, (1 << bits, width)).astype(np.float32)
    weights = rng.normal(0, 0.3, (width, len(names))).astype(np.float32)
    bias = np.zeros(len(names), np.float32)
    train = np.flatnonzero(~held)
    for epoch in range(epochs):
        order = rng.permutation(train)
        for k, t in zip(order, _windows([texts[k] for k in order], rng), strict=True):
            data = np.frombuffer(f" {t} ".lower().encode(), np.uint8)
            keys, counts = np.unique(np.concatenate([grams(data, n, bits) for n in GRAMS]), return_counts=True)
            share = (counts / counts.sum()).astype(np.float32)
            mean = share @ emb[keys]
            z = mean @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[k]] -= 1
            step = rate * (1 - epoch / epochs)
            back = weights @ p
            weights -= 0.05 * step * np.outer(mean, p)
            bias -= 0.01 * step * p
            emb[keys] -= step * np.outer(share, back)
    model = Model(names, np.ascontiguousarray((emb @ weights).astype(np.float64)), bias.astype(np.float64), bits, 1.0, 0.0)
    check = np.flatnonzero(held) if held.any() else train
    truth = np.concatenate([y[check]] * 4)
    windows = [w for _ in range(4) for w in _windows([texts[k] for k in check], rng)]
    z = np.log(model.scores(windows) + 1e-300)
    loss = lambda t: -np.mean((z / t - np.logaddexp.reduce(z / t, axis=1, keepdims=True))[np.arange(len(truth)), truth])
    model.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
    p = np.exp(z / model.temperature)
    p /= p.sum(1, keepdims=True)
    right = p.argmax(1) == truth
    model.threshold = float(np.quantile(p[right].max(1), REJECTED)) if right.any() else 0.0
    return model


def held_out(key: str = "doc_id") -> Column:
    """Rows that nothing is learned from: CRC-32 of the key as text divisible by 5; a NULL key counts as empty."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> Model | None:
    """Fits on a bounded sample: of each language :data:`TRAIN_ROWS` rows of least hash outside :func:`held_out`.

    Of each row a window of :data:`TRAIN_CHARS` code points goes to the driver, starting at a hashed place; whole texts are
    what :func:`predict` reads. None if no row has a label and a letter.
    """
    usable = docs.filter(~held_out(key) & F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}"))
    order = F.pmod(F.xxhash64(F.lit(11), F.col(key), F.col(text)), F.lit(SPREAD))
    start = F.pmod(F.xxhash64(F.lit(12), F.col(key)), F.greatest(F.length(text) - TRAIN_CHARS + 1, F.lit(1))).cast("int") + 1
    rows = usable.select(F.col(label).alias("y"), order.alias("h"), F.substring(F.col(text), start, F.lit(TRAIN_CHARS)).alias("t"))
    counts = rows.groupBy("y").count().collect()  # a row per language
    if not counts:
        return None
    # Hashes spread evenly, so half as many again as are needed lie below these; few rows are sorted, in one pass for all languages.
    below = {r["y"]: SPREAD if r["count"] <= 2 * TRAIN_ROWS else SPREAD * 3 * TRAIN_ROWS // (2 * r["count"]) for r in counts}
    limits = F.create_map(*(F.lit(x) for y, h in below.items() for x in (y, h)))
    turn = F.row_number().over(Window.partitionBy("y").orderBy("h", "t"))
    some = rows.filter(F.col("h") < F.try_element_at(limits, F.col("y"))).withColumn("turn", turn).filter(F.col("turn") <= TRAIN_ROWS)
    sample = sorted(some.collect(), key=lambda r: (r["y"], r["turn"]))
    return fit([r["t"] for r in sample], [r["y"] for r in sample])


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Adds ``lang_pred``, ``score`` (probability of that label) and ``rejected`` (below the model's threshold, or undetermined).

    Reads whole texts and nothing else. NULL texts and texts without a letter are ``und`` with score 0, as is every text
    without a model. Equal texts get equal results. Columns of ``docs`` with those names are replaced.
    """
    small_batches(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    docs = docs.select(*own)
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0), "rejected": F.lit(True)})

    @F.pandas_udf("label int, score double")
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in tidy(batches):
            p = model.scores(texts.tolist()) if len(texts) else np.zeros((0, 1))
            yield pd.DataFrame({"label": p.argmax(1).astype(np.int32), "score": p.max(1)})

    letters = F.col(text).rlike(r"\p{L}")
    found = docs.withColumn("_best", best(F.coalesce(F.col(text), F.lit(""))))
    clear = F.coalesce(letters, F.lit(False))
    names = F.array(*(F.lit(x) for x in model.labels))
    score = F.when(clear, F.col("_best.score")).otherwise(0.0)
    return found.select(
        *(F.col(f"`{c}`") for c in own), F.when(clear, F.element_at(names, F.col("_best.label") + 1)).otherwise(UNDETERMINED).alias("lang_pred"),
        score.alias("score"), (~clear | (score < model.threshold)).alias("rejected"),
    )


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """Trains on ``docs`` and returns ``key``, ``held_out``, ``lang_pred``, ``score`` and ``rejected`` for each row of it.

    See :func:`train` and :func:`predict`. Labels that are NULL are not learned; repeated rows are rows of their own; an
    empty table gives no rows.
    """
    rows = docs.select(F.col(key), held_out(key).alias("held_out"), F.col(text).alias("_text"))
    found = predict(rows, train(docs, key, text, label), "_text")
    return found.select(key, "held_out", "lang_pred", "score", "rejected")
