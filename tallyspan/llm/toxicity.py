"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Training reads a bounded sample of labelled rows (``max_rows``, the rows with
the smallest hash of their id).  Per-coordinate learning rates and the L1 term
leave a sparse weight vector, which travels to the executors inside the
scoring function; its size is bounded by ``2**bits`` entries.

Defined results: null and empty texts get the score of the bias alone, a null
``doc_id`` is never held out and never trained on, repeated rows are scored
alike, an empty table gives an empty result, and without labelled rows of both
classes every score is the prior.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, arrow_schema, as_bytes, held_out, map_batches, reachable

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def features(text: bytes | None, bits: int) -> np.ndarray:
    """Hashed unigrams, bigrams and one-gap skip-grams, repeats included."""
    words = alnum_words(text)
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    parts = [h * _MIX[0]]
    parts += [(h[:-1] * _MIX[1]) ^ (h[1:] * _MIX[0])] if len(h) > 1 else []
    parts += [(h[:-2] * _MIX[2]) ^ (h[2:] * _MIX[0] + np.uint64(1))] if len(h) > 2 else []
    every = np.concatenate(parts)
    every ^= every >> np.uint64(32)
    every *= _MIX[0]
    return (every >> np.uint64(64 - bits)).astype(np.int64)


def row_features(text: bytes | None, bits: int) -> np.ndarray:
    """Distinct features of a text, as four bytes each."""
    return np.unique(features(text, bits)).astype(np.int32)


@dataclass
class Model:
    """Sparse weights, and the two numbers that turn a margin into a probability."""

    bits: int
    index: np.ndarray
    weight: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.bits, np.float32)
        w[self.index] = self.weight
        return w

    def margin(self, text: bytes | None, w: np.ndarray) -> float:
        x = features(text, self.bits)
        x = np.unique(x[w[x] != 0])  # a feature counts once, however long the text
        return self.bias + float(w[x].astype(np.float64).sum())

    def probability(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale * margin + self.shift, -30, 30))))


def fit_rows(rows: list[tuple[np.ndarray, int]], bits: int = 20, alpha: float = 0.3, beta: float = 1.0,
             l1: float | None = None, l2: float = 0.1, epochs: int = 5) -> Model:
    """FTRL-proximal over (distinct features, label); a fifth of the rows is kept back for Platt scaling.

    ``l1`` defaults to an eighth of the root of the row count, because the summed
    gradient of a feature that says nothing wanders by about that root.
    """
    l1 = max(1.0, len(rows) ** 0.5 / 8) if l1 is None else l1
    fit, kept = [r for i, r in enumerate(rows) if i % 5], [r for i, r in enumerate(rows) if i % 5 == 0]
    z, n, b, bn = np.zeros(1 << bits), np.zeros(1 << bits), 0.0, 1.0
    for _ in range(epochs if len({y for _, y in fit}) == 2 else 0):
        for x, y in fit:
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) > l1, -(zx - np.sign(zx) * l1) / ((beta + np.sqrt(nx)) / alpha + l2), 0.0)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -30, 30)))
            g = p - y
            n[x] = nx + g * g
            z[x] = zx + g - (np.sqrt(n[x]) - np.sqrt(nx)) / alpha * w
            bn += g * g
            b -= 0.1 * g / np.sqrt(bn)
    w = np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)
    index = np.flatnonzero(w)
    model = Model(bits, index, w[index].astype(np.float32), b)
    if len({y for _, y in kept}) == 2 and len(index):
        dense = model.dense()
        m, y = np.array([model.bias + float(dense[x].astype(np.float64).sum()) for x, _ in kept]), np.array([y for _, y in kept], float)
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        a, c = 1.0, 0.0
        for _ in range(100):  # Newton steps on two numbers
            p = 1 / (1 + np.exp(-np.clip(a * m + c, -30, 30)))
            s = p * (1 - p) + 1e-6
            grad = np.array([((p - target) * m).sum() + 1e-3 * (a - 1), (p - target).sum()])
            hess = np.array([[(s * m * m).sum() + 1e-3, (s * m).sum()], [(s * m).sum(), s.sum()]])
            step = np.linalg.solve(hess, grad)
            a, c = a - step[0], c - step[1]
            if np.abs(step).max() < 1e-9:
                break
        if a > 0:
            model.scale, model.shift = float(a), float(c)
    elif rows and not len(index):
        p = (sum(y for _, y in rows) + 1) / (len(rows) + 2)
        model.bias = float(np.log(p / (1 - p)))
    return model


def labelled(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """A bounded, repeatable sample of (text, label); rows of the test fold never enter."""
    chosen = (labels.select("doc_id", F.col("toxic").cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
              .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
              .groupBy("doc_id").agg(F.max("y").alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    texts = docs.select("doc_id", as_bytes().alias("text"))
    return (texts.join(F.broadcast(chosen), "doc_id")  # at most max_rows rows of two numbers
            .orderBy(F.xxhash64("doc_id"), "doc_id", F.md5("text")).limit(max_rows).select("text", "y"))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 12000, bits: int = 20, **options) -> Model:
    """Fit on at most ``max_rows`` labelled documents, in the one task that holds them; the driver gets the sparse weights alone."""
    reachable(docs.sparkSession)
    ddl = "size long, index binary, weight binary, bias double, scale double, shift double"
    schema = arrow_schema(ddl)

    def run(batches):
        rows = []
        for batch in batches:
            for text, y in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append((row_features(text, bits), y))
        m = fit_rows(rows, bits, **options)
        cells = (len(rows), m.index.astype(np.int64).tobytes(), m.weight.tobytes(), m.bias, m.scale, m.shift)
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, schema)], schema=schema)

    # The sample leaves its sort as one ordered partition; without any partition there is nothing to fit.
    found = [r for r in labelled(docs, labels, max_rows).coalesce(1).mapInArrow(run, ddl).collect() if r["size"]]
    if not found:
        return fit_rows([], bits, **options)
    m = found[0]
    return Model(bits, np.frombuffer(m["index"], np.int64), np.frombuffer(m["weight"], np.float32), m["bias"], m["scale"], m["shift"])


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    cell: list = []

    def run(ids, texts):
        if not cell:
            cell.append(model.dense())
        p = [model.probability(model.margin(t, cell[0])) for t in texts]
        return {"doc_id": ids, "held_out": [held_out(i, 3) for i in ids], "score": p, "predicted": [int(x >= threshold) for x in p]}

    return map_batches(docs.select(F.col("doc_id").cast("long"), as_bytes().alias("text")), run,
                       "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents whose score is under the threshold, with all their columns."""
    model = train(docs, labels)
    cell: list = []

    def run(batches):
        for batch in batches:
            if not cell:
                cell.append(model.dense())
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
            keep = [model.probability(model.margin(t.as_py(), cell[0])) < threshold for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
